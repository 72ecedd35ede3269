"""Mixing sources to target weights by Sainte-Laguë apportionment.

1. Weights: sources in code-point order (null last) weigh 3, 1, 2, 3, 1, 2, ...; together they share `share` times all words. A
   source's target is capped at `repeats` times its size and the excess is reshared by weight (water filling).
2. Seats: the total, in blocks of `block` words, is apportioned to the sources by the highest quotients target / (2k+1); then each
   source's seats go to its shards by the same rule with the shards' sizes as votes.
3. Selection: a shard lays its documents end to end in a seeded order. A quota of q blocks takes q * block words: whole
   laps of the shard, then one seeded run of consecutive blocks. So nearly every document is taken whole, and no word more often
   than `repeats` times.

Shards hold about `shard_words` words of one source (at most `most_shards` a source; then they grow); a source with a third of all rows
has so many more shards, and no task sees more than a shard's rows of a few numbers. Sources and shards are the only groups ranked together.

Nulls: a null text has size 0; a null source is a source of its own, last in order; null ids are kept. Repeated
rows are separate documents (ties in the seeded order are broken by size, and equal rows are interchangeable). An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm.common import SPACED_WORD, materialize

WEIGHTS = (3, 1, 2)


def source_targets(totals: DataFrame, share: float = 1.5, repeats: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """`totals` (source, source_size, ...) with `weight` and `target` (double): water filling in one ordered pass.

    A source is capped when repeats*size/weight is at most the level reached by the others; with the ratios sorted, the
    level after capping the first k is (total - their caps) / (weights of the rest).
    """
    cycle = F.array(*[F.lit(w) for w in weights])
    by_name = W.orderBy(F.col("source").isNull(), "source")
    up = W.orderBy("ratio", F.col("source").isNull(), "source")
    out = (
        totals.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("double"))
        .withColumn("cap", F.col("source_size") * F.lit(float(repeats)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(W.partitionBy()) * F.lit(share))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(up.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("caps_before")) / F.col("weight_left"))
        .withColumn("open_level", F.when(F.col("ratio") > F.col("level"), F.col("level")))
        .withColumn("first_open", F.max("open_level").over(W.partitionBy()))
    )
    # the level is the one at the first source that isn't capped; it falls again after that, so the largest open level is the first
    return out.withColumn("target", F.least("cap", F.coalesce(F.col("weight") * F.col("first_open"), F.col("cap")))).drop("cap", "ratio", "total", "caps_before", "weight_left", "level", "open_level", "first_open")


def apportion(votes: DataFrame, group: list[str], vote: str, seats: str, order: list) -> DataFrame:
    """Sainte-Laguë within each group: adds `quota`, whose sum is the group's `seats`.

    Party i gets at least floor(q - 1/2) and seats above that by its next quotients; with q = seats * vote / votes those that can win lie
    within a few steps of q, because the divisor differs from votes/seats by at most parties/2 seats. The base is taken a little low for
    all (divisor votes / (seats - parties/2)), and only the missing seats - at most one and a half per party - are ranked.
    """
    own = W.partitionBy(*group)
    n = F.count(F.lit(1)).over(own)
    based = (
        votes.withColumn("_all", F.sum(vote).over(own)).withColumn("_n", n)
        .withColumn("_q", F.when(F.col("_all") > 0, F.greatest(F.col(seats) - F.col("_n") / 2, F.lit(0.0)) * F.col(vote) / F.col("_all")).otherwise(0.0))
        .withColumn("_base", F.floor(F.col("_q") + F.lit(0.5)).cast("long"))
        .withColumn("_more", (F.col(seats) - F.sum("_base").over(own)).cast("long"))
        # no party can win more of the missing seats than this: its exact quota, the gap to the base, and one for rounding
        .withColumn("_most", F.when(F.col("_all") > 0, F.least(F.col("_more"), F.ceil(F.col(seats) * F.col(vote) / F.col("_all") - F.col("_base") + F.col("_n") * F.col(vote) / F.col("_all")).cast("long") + 2)).otherwise(F.lit(0).cast("long")))
    )
    ranked = (
        based.where("_most > 0 AND _more > 0")
        .select(*votes.columns, "_base", "_more", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_most") - 1)).alias("_k"))
        .withColumn("_quot", F.col(vote) / (2 * (F.col("_base") + F.col("_k")) + 1))
        .withColumn("_rank", F.row_number().over(own.orderBy(F.col("_quot").desc(), *order, "_k")))
        .where(F.col("_rank") <= F.col("_more"))
    )
    key = [c for c in votes.columns if c not in (vote, seats)]
    won = ranked.groupBy(*[F.col(c).alias(f"_w_{c}") for c in key]).agg(F.count(F.lit(1)).alias("_won"))
    same = [F.col(c).eqNullSafe(F.col(f"_w_{c}")) for c in key]
    return based.join(won, same, "left").select(*votes.columns, (F.col("_base") + F.coalesce("_won", F.lit(0))).cast("long").alias("quota"))


def spot_of(seed: int, doc_id: Column, text: Column) -> Column:
    """A document's place in the seeded order: keyed MD5 of id and text, in hexadecimal."""
    return F.md5(F.concat_ws("|", F.lit(seed), doc_id, text))


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", *, share: float = 1.5, repeats: int = 2,
    weights: tuple[int, ...] = WEIGHTS, block: int = 16, shard_words: int = 1 << 17, shard_rows: int = 4096, most_shards: int = 1 << 16, seed: int = 7,
) -> DataFrame:
    """Per row of `docs`: doc_id, size, source, source_size, target, spot, start, laps, first, last, wrap, taken (long).

    The mix takes the whole text `laps` times and its words [first, last) and [0, wrap) once more (the run may wrap around the shard's end).
    """
    measured = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(SPACED_WORD)), F.lit(0)).cast("long").alias("size"),
        spot_of(seed, F.col(doc_id), F.col(text)).alias("spot"),
    )
    sizes = materialize(measured, "mixing-sizes")
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    goals = source_targets(totals, share, repeats, weights).withColumn("seats", F.round(F.sum("target").over(W.partitionBy()) / block).cast("long"))
    won = apportion(goals.select("source", F.col("target").alias("vote"), "seats"), [], "vote", "seats", [F.col("source").isNull(), F.col("source")])
    won = won.select(F.col("source").alias("_s"), F.col("quota").alias("source_quota"))
    goals = materialize(
        goals.join(won, F.col("source").eqNullSafe(F.col("_s"))).select(
            "source", "source_size", "target", "source_quota",
            F.least(F.lit(most_shards), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words), F.ceil(F.col("source_rows") / shard_rows))).cast("long").alias("shards"),
        ),
        "mixing-goals",
    )
    g = goals.withColumnRenamed("source", "_s")
    dealt = sizes.join(g, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("shard", _number(F.col("spot")) % F.col("shards"))
    shards = dealt.groupBy("source", "shard").agg(F.sum("size").alias("vote"), F.max("source_quota").alias("seats"))
    quotas = materialize(apportion(shards, ["source"], "vote", "seats", [F.col("shard")]).select(F.col("source").alias("_s"), F.col("shard").alias("_h"), F.col("vote").alias("shard_size"), "quota"), "mixing-quotas")

    line = W.partitionBy("source", "shard").orderBy("spot", "doc_id", "size")
    laid = dealt.withColumn("start", F.sum("size").over(line.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    placed = laid.join(quotas, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_h")))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("shard_size") / block))
    words = F.least(F.col("quota") * block, F.col("shard_size") * repeats)
    placed = (
        placed.withColumn("laps", F.when(F.col("shard_size") > 0, F.floor(words / F.col("shard_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("run", (words - F.col("laps") * F.col("shard_size")).cast("long"))
        .withColumn("at", F.when(F.col("shard_size") > 0, _number(F.md5(F.concat_ws("|", F.lit(seed + 1), "source", "shard"))) % blocks * block).otherwise(0).cast("long"))
        .withColumn("end", F.col("at") + F.col("run"))
        .withColumn("first", F.least("size", F.greatest(F.lit(0), F.col("at") - F.col("start"))))
        .withColumn("last", F.least("size", F.greatest(F.col("first"), F.col("end") - F.col("start"))))
        .withColumn("wrap", F.least("size", F.greatest(F.lit(0), F.col("end") - F.col("shard_size") - F.col("start"))))
    )
    return placed.select(
        "doc_id", "source", "size", "source_size", "target", "spot", *[F.col(c).cast("long").alias(c) for c in ("start", "laps", "first", "last", "wrap")],
        (F.col("laps") * F.col("size") + F.col("last") - F.col("first") + F.col("wrap")).cast("long").alias("taken"),
    )
