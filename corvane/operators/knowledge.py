"""Knowledge-graph dataflow: merging nodes and mentions, distance rules, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def merged_nodes(parts: DataFrame) -> DataFrame:
    """node_id, aliases in order of first appearance, highest confidence, first attribute; `parts`: node_id, alias, confidence, attribute, seq."""
    seen = F.transform(F.array_sort(F.collect_list(F.struct("seq", "alias"))), lambda x: x["alias"])
    return parts.groupBy("node_id").agg(F.array_distinct(seen).alias("aliases"), F.max("confidence").alias("confidence"), F.min_by("attribute", "seq").alias("attribute"))


def grouped_candidates(candidates: DataFrame) -> DataFrame:
    """By type and case-folded name: the most confident, earliest candidate speaks for its group."""
    return candidates.groupBy("kind", F.lower("name").alias("name_key")).agg(
        F.max_by("candidate_id", F.struct("confidence", -F.col("start"), -F.col("doc_id"))).alias("representative"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("members"))


def best_mentions(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("node_id", "document_id").agg(F.max("confidence").alias("confidence"))


def nearest_within(left: DataFrame, right: DataFrame, reach: int) -> DataFrame:
    """For each left row (doc_id, left_id, at) the nearest right row (doc_id, right_id, at) of its document within `reach`; ties to the smaller id.

    An equi-join on document and on buckets of `reach` positions: a row meets three buckets, not its whole document.
    """
    a = left.withColumn("_b", F.explode(F.array(*[(F.floor(F.col("at") / reach) + d) for d in (-1, 0, 1)])))
    b = right.select("doc_id", "right_id", F.col("at").alias("_at"), F.floor(F.col("at") / reach).alias("_b"))
    near = a.join(b, ["doc_id", "_b"]).withColumn("distance", F.abs(F.col("at") - F.col("_at"))).where(F.col("distance") <= reach)
    w = W.partitionBy("doc_id", "left_id").orderBy("distance", "right_id")
    return near.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("doc_id", "left_id", "right_id", "distance")


def relation_issues(relations: DataFrame, rules: DataFrame) -> DataFrame:
    """relation_id, issues (sorted): self loops, evidence that isn't in the text, endpoint kinds that `rules` (relation, source_kind, target_kind) don't allow."""
    ok = relations.join(rules.withColumn("_ok", F.lit(True)), ["relation", "source_kind", "target_kind"], "left")
    flags = F.array(F.when(F.col("source_id") == F.col("target_id"), "self"), F.when(~F.contains("content", "evidence"), "evidence"), F.when(F.col("_ok").isNull(), "kinds"))
    return ok.select("relation_id", F.array_join(F.sort_array(F.filter(flags, lambda x: x.isNotNull())), ",").alias("issues"))
