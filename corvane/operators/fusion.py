"""Combining ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.operators.lexical import max_normalised


def reciprocal_ranks(branches: DataFrame, key: str, k: int = 60) -> DataFrame:
    """`branches` (query_id, branch, weight, key, score) -> query_id, key, raw, score: sum of weight / (k + rank), divided by its maximum."""
    place = F.row_number().over(W.partitionBy("query_id", "branch").orderBy(F.desc("score"), key))
    summed = branches.withColumn("r", place).groupBy("query_id", key).agg(F.sum(F.col("weight") / (k + F.col("r"))).alias("raw"))
    return max_normalised(summed)


def reranked(base: DataFrame, key: str, strategy: str = "weighted_rrf", weight: float = 0.5, k: int = 60) -> DataFrame:
    """`base` (query_id, key, score, rerank) with base_rank, rerank_rank and final_rank.

    replace: by the reranker alone; weighted_rrf: (1-w)/(k+base rank) + w/(k+rerank rank); ties keep the base order.
    """
    if strategy not in ("replace", "weighted_rrf"):
        raise ValueError(strategy)
    q = W.partitionBy("query_id")
    out = base.withColumn("base_rank", F.row_number().over(q.orderBy(F.desc("score"), key)))
    out = out.withColumn("rerank_rank", F.row_number().over(q.orderBy(F.desc("rerank"), "base_rank")))
    mixed = (1 - weight) / (k + F.col("base_rank")) + weight / (k + F.col("rerank_rank"))
    order = F.desc("rerank") if strategy == "replace" else F.round(mixed, 9).desc()
    return out.withColumn("final_rank", F.row_number().over(q.orderBy(order, "base_rank")))


def best_per_document(hits: DataFrame, doc: str, k: int, *order) -> DataFrame:
    """The best hit of each document, then the k best documents: one pass instead of growing result windows."""
    first = hits.withColumn("_n", F.row_number().over(W.partitionBy("query_id", doc).orderBy(*order))).where("_n = 1").drop("_n")
    return first.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def candidates(hits: DataFrame, doc: str, documents: int, each: int, *order) -> DataFrame:
    """The first `documents` documents by their best hit, and of each the first `each` hits; doc_rank and hit_rank."""
    out = hits.withColumn("_r", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))
    out = out.withColumn("_first", F.min("_r").over(W.partitionBy("query_id", doc)))
    out = out.withColumn("doc_rank", F.dense_rank().over(W.partitionBy("query_id").orderBy("_first")))
    out = out.withColumn("hit_rank", F.row_number().over(W.partitionBy("query_id", doc).orderBy("_r")))
    return out.where((F.col("doc_rank") <= documents) & (F.col("hit_rank") <= each)).drop("_r", "_first")
