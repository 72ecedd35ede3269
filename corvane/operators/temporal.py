"""Bi-temporal memory: what was valid at one time, as known at another."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators.dense import cosine

INVALIDATING = {"supersedes": "SUPERSEDED", "corrects": "CORRECTED", "retracts": "RETRACTED"}


def _time(t: dt.datetime | str | Column) -> Column:
    return t if isinstance(t, Column) else F.lit(str(t)).cast("timestamp")


def resolve(assertions: DataFrame, relations: DataFrame, valid_at, known_at) -> DataFrame:
    """Each assertion known by `known_at` with lifecycle, valid_to, contradictions and reinforcements.

    `relations` (relation_id, target_assertion_id, relation_type, effective_at, recorded_at) count if recorded by `known_at` and effective by `valid_at`; of
    several that invalidate, the earliest (effective, recorded, id) decides. Relations are folded by target before the join, so a much-related assertion
    is one row there.
    """
    valid_at, known_at = _time(valid_at), _time(known_at)
    seen = assertions.where(F.col("recorded_at") <= known_at)
    count = relations.where((F.col("recorded_at") <= known_at) & (F.col("effective_at") <= valid_at))
    ends = F.col("relation_type").isin(*INVALIDATING)
    folded = count.groupBy(F.col("target_assertion_id").alias("assertion_id")).agg(
        F.min(F.when(ends, F.struct("effective_at", "recorded_at", "relation_id", "relation_type"))).alias("ended"),
        F.count_if(F.col("relation_type") == "contradicts").alias("contradictions"), F.count_if(F.col("relation_type") == "reinforces").alias("reinforcements"),
    )
    out = seen.join(folded, "assertion_id", "left")
    state = F.when(F.col("valid_from") > valid_at, "FUTURE")
    for kind, name in INVALIDATING.items():
        state = state.when(F.col("ended.relation_type") == kind, name)
    state = state.when(F.col("contradictions") > 0, "CONTESTED").otherwise("ACTIVE")
    return out.withColumn("lifecycle", state).withColumn("valid_to", F.when(F.col("lifecycle") != "FUTURE", F.col("ended.effective_at"))).withColumn(
        "contradictions", F.coalesce("contradictions", F.lit(0))).withColumn("reinforcements", F.coalesce("reinforcements", F.lit(0))).drop("ended")


def succession(assertions: DataFrame, by: list[str]) -> DataFrame:
    """Relations by which each assertion supersedes the one before it with the same key: in force from its own start, known when it is."""
    from pyspark.sql import Window as W

    before = F.lag("assertion_id").over(W.partitionBy(*by).orderBy("valid_from", "assertion_id"))
    return assertions.withColumn("target_assertion_id", before).where("target_assertion_id IS NOT NULL").select(
        F.col("assertion_id").alias("relation_id"), "target_assertion_id", F.lit("supersedes").alias("relation_type"), F.col("valid_from").alias("effective_at"), "recorded_at")


def usage(ids: DataFrame, events: DataFrame) -> DataFrame:
    """uses, successful, rejected and last use for each of `ids`; zeros for unused ones. `events`: assertion_id, outcome, at."""
    sums = events.groupBy("assertion_id").agg(
        F.count(F.lit(1)).alias("uses"), F.count_if(F.col("outcome") == "successful").alias("successful"), F.count_if(F.col("outcome") == "rejected").alias("rejected"), F.max("at").alias("last_used"))
    return ids.join(sums, "assertion_id", "left").fillna(0, ["uses", "successful", "rejected"])


def searched(states: DataFrame, usages: DataFrame, lexical: DataFrame, query: Column | None, valid_at, mode: str = "latest_valid", k: int = 20, digits: int = 6) -> DataFrame:
    """Score the states a mode admits; `lexical` (assertion_id, lex_rank from 1); vectors in `v` where a query vector is given."""
    if mode not in ("latest_valid", "historical"):
        raise ValueError(mode)
    ok = F.col("lifecycle").isin("ACTIVE", "CONTESTED") if mode == "latest_valid" else F.col("lifecycle") != "FUTURE"
    s = states.where(ok).join(usages, "assertion_id", "left").join(lexical, "assertion_id", "left")
    semantic = F.lit(0.0) if query is None else F.coalesce(F.greatest(cosine(F.col("v"), query), F.lit(0.0)), F.lit(0.0))
    lex = F.coalesce(1.0 / F.col("lex_rank"), F.lit(0.0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    force = T.reinforcement(zero("uses"), zero("successful"), zero("rejected"), zero("reinforcements"))
    times = F.when(F.col("lifecycle") == "CONTESTED", 0.82).when(F.col("lifecycle") == "ACTIVE", 1.0).otherwise(0.94)
    score = times * (0.60 * semantic + 0.15 * lex + 0.10 * F.col("confidence") + 0.08 * F.col("importance") + 0.05 * force + 0.02 * T.recency(F.col("valid_from"), _time(valid_at)))
    return s.withColumn("score", F.round(score, digits)).orderBy(F.desc("score"), F.desc("valid_from"), "assertion_id").limit(k)


def pending(events: DataFrame, runs: DataFrame, key: str = "event_id") -> DataFrame:
    """Events no consolidation run has taken."""
    return events.join(runs.select(key).distinct(), key, "left_anti")


def applied(ledger: DataFrame, proposals: DataFrame, key: str = "proposal_id") -> DataFrame:
    """The ledger with those proposals appended that it doesn't hold: applying twice is applying once."""
    return ledger.unionByName(proposals.dropDuplicates([key]).join(ledger.select(key), key, "left_anti").select(ledger.columns))


def violations(relations: DataFrame, assertions: DataFrame) -> DataFrame:
    """relation_id, issue: relations to themselves, to or from unknown assertions, or between subjects."""
    ends = assertions.select("assertion_id", "subject_id")
    r = relations.join(ends.select(F.col("assertion_id").alias("target_assertion_id"), F.col("subject_id").alias("_t")), "target_assertion_id", "left").join(
        ends.select(F.col("assertion_id").alias("source_assertion_id"), F.col("subject_id").alias("_s")), "source_assertion_id", "left")
    issue = (
        F.when(F.col("source_assertion_id") == F.col("target_assertion_id"), "self").when(F.col("_t").isNull(), "unknown target")
        .when(F.col("source_assertion_id").isNotNull() & F.col("_s").isNull(), "unknown source").when(F.col("_s") != F.col("_t"), "other subject")
    )
    return r.select("relation_id", issue.alias("issue")).where("issue IS NOT NULL")
