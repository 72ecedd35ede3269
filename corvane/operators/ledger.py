"""Source versions: append-only history with one active version an asset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered(versions: DataFrame, asset: str = "asset_id", *order) -> DataFrame:
    """version_number from 1 within an asset."""
    return versions.withColumn("version_number", F.row_number().over(W.partitionBy(asset).orderBy(*order)))


def next_numbers(versions: DataFrame, assets: DataFrame, asset: str = "asset_id") -> DataFrame:
    return assets.select(asset).join(versions.groupBy(asset).agg(F.max("version_number").alias("_top")), asset, "left").select(asset, (F.coalesce("_top", F.lit(0)) + 1).alias("next_number"))


def latest(versions: DataFrame, asset: str = "asset_id", by: str = "version_number") -> DataFrame:
    """The active version: the last one activated."""
    return versions.withColumn("_n", F.row_number().over(W.partitionBy(asset).orderBy(F.desc(by)))).where("_n = 1").drop("_n")


def published(history: DataFrame, incoming: DataFrame, asset: str = "asset_id", mark: str = "fingerprint") -> DataFrame:
    """`incoming` assets and what publishing does to each: unchanged (same fingerprint as active), reused (an earlier version has the content), or new with its number."""
    active = latest(history, asset).select(asset, F.col(mark).alias("_active"))
    earlier = history.groupBy(asset, mark).agg(F.max("version_number").alias("_same"))
    top = history.groupBy(asset).agg(F.max("version_number").alias("_top"))
    out = incoming.join(active, asset, "left").join(earlier, [asset, mark], "left").join(top, asset, "left")
    what = F.when(F.col("_active") == F.col(mark), "unchanged").when(F.col("_same").isNotNull(), "reused").otherwise("new")
    return out.select(asset, mark, what.alias("outcome"), F.when(what == "new", F.coalesce("_top", F.lit(0)) + 1).otherwise(F.col("_same")).cast("long").alias("version_number"))


def reconciled(active: DataFrame, corpus: DataFrame, key: str) -> DataFrame:
    """key, problem: what a rebuild would leave over or miss; empty means the sets are equal."""
    gone = active.select(key).join(corpus.select(key), key, "left_anti").withColumn("problem", F.lit("stale"))
    return gone.unionByName(corpus.select(key).join(active.select(key), key, "left_anti").withColumn("problem", F.lit("missing")))


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `old` whose key isn't in `new`, and all of `new`."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def deduplicated(sources: DataFrame, content: str, path: str) -> DataFrame:
    """One row for each content (white space collapsed): its hash, smallest path, all paths sorted, and their number.

    A row holds all its paths; for contents of very many copies see `canonical_paths`."""
    from corvane.functions.text import content_hash

    return sources.groupBy(content_hash(F.col(content)).alias("content_hash")).agg(F.min(path).alias("canonical"), F.sort_array(F.collect_set(path)).alias("aliases"), F.count(F.lit(1)).alias("copies"))


def canonical_paths(sources: DataFrame, content: str, path: str) -> DataFrame:
    """path, content_hash, canonical: a row for each path, so no row grows with the copies of a content."""
    from corvane.functions.text import content_hash

    rows = sources.select(path, content_hash(F.col(content)).alias("content_hash"))
    return rows.join(rows.groupBy("content_hash").agg(F.min(path).alias("canonical")), "content_hash").select(path, "content_hash", "canonical")


def snapshot(edges: DataFrame, documents: DataFrame, version: str, published: DataFrame) -> DataFrame:
    """`edges` as the graph of a new version: (version, source_id, target_id, relation, confidence), the strongest of equal ones.

    `published` (version) are the versions there are; a version is never published twice, and an edge to an unknown document is an error."""
    if not published.where(F.col("version") == version).isEmpty():
        raise ValueError(f"version already exists: {version}")
    ends = edges.select(F.col("source_id").alias("document_id")).unionByName(edges.select(F.col("target_id").alias("document_id")))
    if not ends.join(documents.select("document_id"), "document_id", "left_anti").isEmpty():
        raise ValueError("an edge names an unknown document")
    best = edges.groupBy("source_id", "target_id", "relation").agg(F.max("confidence").alias("confidence"))
    return best.select(F.lit(version).alias("version"), "source_id", "target_id", "relation", "confidence")


def relations_for(current: DataFrame, new: DataFrame, replace: bool) -> DataFrame:
    """What a publish makes of relations: the new ones alone, or both, the strongest of equal ones."""
    return (new if replace else current.unionByName(new)).groupBy("source_id", "target_id", "relation").agg(F.max("confidence").alias("confidence"))


def pointed(log: DataFrame) -> DataFrame:
    """One row (index_version, graph_version) the last complete entry of a log (seq, action, index_version, graph_version, ok) points to.

    Publishing and rolling back append an entry that names both versions; an entry that did not come to its end (ok false) changes neither."""
    last = log.where("ok").agg(F.max_by(F.struct("index_version", "graph_version"), "seq").alias("p"))
    return last.select("p.index_version", "p.graph_version")


def contract_differences(active: DataFrame, wanted: DataFrame) -> DataFrame:
    """field, active, wanted: fields (field, value) that differ, null where one side has none. Empty: the versions may share an index."""
    a, b = active.select("field", F.col("value").alias("active")), wanted.select("field", F.col("value").alias("wanted"))
    return a.join(b, "field", "full").where(~F.col("active").eqNullSafe(F.col("wanted")))


def inherited(previous: DataFrame, pending: DataFrame, key: str, version: str) -> DataFrame:
    """The next version: rows of the previous one whose document isn't pending, and the pending rows, all marked with the version."""
    return upserted(previous.drop("version"), pending.drop("version"), key).withColumn("version", F.lit(version))


def remaining(wanted: DataFrame, built: DataFrame, key: str, contract: str) -> DataFrame:
    """Documents that an interrupted build has still to do: rows of `built` (key, contract, parts, done) count if they follow the contract and are complete."""
    whole = built.where((F.col("contract") == contract) & (F.col("parts") == F.col("done"))).select(key).distinct()
    return wanted.join(whole, key, "left_anti")
