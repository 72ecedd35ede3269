"""Measures of retrieval runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wilson(hits: Column, n: Column, z: float = 1.96) -> Column:
    """struct(low, high) of the Wilson interval, (0, 0) without trials."""
    p = hits / F.greatest(n, F.lit(1))
    base = 1 + z * z / F.greatest(n, F.lit(1))
    mid = (p + z * z / (2 * F.greatest(n, F.lit(1)))) / base
    half = z * F.sqrt(p * (1 - p) / F.greatest(n, F.lit(1)) + z * z / (4 * F.greatest(n, F.lit(1)) * F.greatest(n, F.lit(1)))) / base
    some = n > 0
    return F.struct(F.when(some, F.greatest(F.lit(0.0), mid - half)).otherwise(0.0).alias("low"), F.when(some, F.least(F.lit(1.0), mid + half)).otherwise(0.0).alias("high"))


def rate(flag: Column, digits: int = 4) -> Column:
    return F.round(F.coalesce(F.avg(flag.cast("int")), F.lit(0.0)), digits)


def nearest_rank(values: Column, p: float) -> Column:
    """Percentile of an aggregated array: place round-half-even((n-1) p) of the sorted values."""
    return F.element_at(F.sort_array(values), (F.bround((F.size(values) - 1) * F.lit(p)) + 1).cast("int"))


def ranked_measures(ranked: DataFrame, relevant: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """query_id, recall, reciprocal_rank, ndcg at k. `ranked` (query_id, document_id, rank), `relevant` (query_id, document_id); queries without
    relevant documents score 0."""
    n = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rel"))
    hit = ranked.where(F.col("rank") <= k).join(relevant, ["query_id", "document_id"]).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("found"), F.min("rank").alias("first"), F.sum(1.0 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel").cast("int"), F.lit(k))), F.lit(0.0), lambda s, r: s + 1.0 / F.log2(r + 1.0))
    return queries.select("query_id").join(n, "query_id", "left").join(hit, "query_id", "left").select(
        "query_id", F.round(F.coalesce(F.col("found") / F.col("n_rel"), F.lit(0.0)), 6).alias("recall"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"),
        F.round(F.coalesce(F.col("dcg") / F.when(F.col("n_rel") > 0, ideal), F.lit(0.0)), 6).alias("ndcg"))


def funnel(runs: DataFrame) -> DataFrame:
    """One row over `runs` (query_id, in_candidates, base_top, final_top): how relevant documents pass from candidates to the final list."""
    c, b, f = F.col("in_candidates"), F.col("base_top"), F.col("final_top")
    return runs.agg(
        F.count(F.lit(1)).alias("queries"), F.count_if(c).alias("candidates"), F.count_if(b).alias("base"), F.count_if(f).alias("final"), F.count_if(f & ~b).alias("rescued"),
        F.count_if(b & ~f).alias("lost"), F.count_if(~c).alias("outside"), F.array_join(F.sort_array(F.collect_list(F.when(f & ~b, F.col("query_id")))), ",").alias("rescued_ids"))


def difference(old: DataFrame, new: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """metric, old, new, verdict of two reports (metric, value)."""
    o, n = old.withColumnRenamed("value", "old"), new.withColumnRenamed("value", "new")
    verdict = F.when(F.col("new").isNull(), "missing").when(F.col("old").isNull(), "new").when(F.col("new") < F.col("old") - tolerance, "worse").when(F.col("new") > F.col("old") + tolerance, "better").otherwise("same")
    return o.join(n, "metric", "full").withColumn("verdict", verdict)
