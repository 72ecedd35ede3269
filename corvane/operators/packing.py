"""Budgeted context packs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def truncating(hits: DataFrame, budget: int, by: str = "query_id", size: str = "tokens", order: str = "rank") -> DataFrame:
    """Hits in order until the budget is used; the one that crosses it is cut to what is left (`taken`)."""
    before = F.coalesce(F.sum(size).over(W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return hits.withColumn("_before", before).where(F.col("_before") < budget).withColumn("taken", F.least(F.col(size), budget - F.col("_before"))).drop("_before")


def skipping(hits: DataFrame, budget: int, key: str, by: str = "query_id", size: str = "tokens", order: str = "rank") -> DataFrame:
    """Hits in order, those that no longer fit left out and later, smaller ones still taken: a fold, not a running sum.

    `hits` are a query's candidates, a bounded list.
    """
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("n"), F.col(key).alias("k"))))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("kept"))
    step = lambda s, x: F.when(s["used"] + x["n"] <= budget, F.struct((s["used"] + x["n"]).alias("used"), F.array_append(s["kept"], x["k"].cast("long")).alias("kept"))).otherwise(s)
    packed = hits.groupBy(by).agg(F.aggregate(items, zero, step).alias("p"))
    return packed.select(by, F.col("p.used").alias("used"), F.posexplode("p.kept").alias("place", key))


def covering(hits: DataFrame, k: int, near: float = 0.88) -> DataFrame:
    """query_id, document_id, place: by score, but no hit whose trigrams are `near` those of one taken before; at most k.

    `hits`: query_id, document_id, score, grams; a query's candidates are a bounded list, so their likeness is tested pair by pair first and the
    fold goes over ranks alone.
    """
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "document_id")
    # grams as numbers: sets of longs are compared without boxing
    ranked = hits.select("query_id", "document_id", F.row_number().over(w).alias("r"), F.array_distinct(F.transform("grams", lambda g: F.xxhash64(g))).alias("g"))
    a = ranked.select("query_id", F.col("r").alias("ra"), F.col("g").alias("ga"))
    b = ranked.select("query_id", F.col("r").alias("rb"), F.col("g").alias("gb"))
    common = F.size(F.array_intersect("ga", "gb"))
    alike = a.join(b, "query_id").where("ra < rb").where(common >= near * (F.size("ga") + F.size("gb") - common))
    before = alike.groupBy("query_id", F.col("rb").alias("r")).agg(F.collect_list("ra").alias("like"))
    listed = ranked.drop("g").join(before, ["query_id", "r"], "left").groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("r", "document_id", F.coalesce("like", F.array().cast("array<int>")).alias("like")))).alias("items"))
    step = lambda kept, x: F.when((F.size(kept) < k) & ~F.arrays_overlap(kept, x["like"]), F.array_append(kept, x["r"])).otherwise(kept)
    kept = listed.select("query_id", F.posexplode(F.aggregate("items", F.array().cast("array<int>"), step)).alias("p", "r"))
    return kept.join(ranked.drop("g"), ["query_id", "r"]).select("query_id", "document_id", (F.col("p") + 1).alias("place"))
