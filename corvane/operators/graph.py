"""Document graphs: edges, authorised expansion, projections from shared entities, hyperedges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import text as T


def strongest(edges: DataFrame) -> DataFrame:
    """One edge for each (source, target, relation): the most confident, the first of equals (`seq`); no edge to itself."""
    w = W.partitionBy("source_id", "target_id", "relation").orderBy(F.desc("confidence"), "seq")
    return edges.where("source_id <> target_id").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Endpoints that are no node."""
    ends = edges.select(F.col("source_id").alias("node")).unionByName(edges.select(F.col("target_id").alias("node"))).distinct()
    return ends.join(nodes.select(F.col("document_id").alias("node")), "node", "left_anti")


def expand(edges: DataFrame, allowed: DataFrame, seeds: DataFrame, max_hops: int = 2, limit: int = 12) -> DataFrame:
    """Paths from `seeds` (query_id, node, ord), breadth first, over nodes of `allowed` only, none twice in a path.

    The first `limit` paths in breadth-first order stay (order of seeds, then of edges `seq`), then they are ranked by hops and
    confidence. The order is carried as an array of ordinals, so it is exact without walking. Columns: query_id, path,
    confidence, hops, rank. Hops (at most 4) are iterated joins; only edges between allowed nodes enter them.
    """
    if not 1 <= max_hops <= 4:
        raise ValueError("hops: 1 to 4")
    ok = allowed.select(F.col("document_id").alias("node"))
    e = edges.join(ok.withColumnRenamed("node", "source_id"), "source_id", "left_semi").join(ok.withColumnRenamed("node", "target_id"), "target_id", "left_semi")
    e = e.select("source_id", "target_id", "confidence", "seq")
    level = seeds.join(ok, "node", "left_semi").select("query_id", F.array("node").alias("path"), F.lit(1.0).alias("confidence"), F.array(F.col("ord").cast("long")).alias("ords"))
    found = None
    for hop in range(1, max_hops + 1):
        at = level.withColumn("source_id", F.element_at("path", -1)).withColumnRenamed("confidence", "so_far")
        level = at.join(e, "source_id").where(~F.array_contains("path", F.col("target_id"))).select(
            "query_id", F.array_append("path", F.col("target_id")).alias("path"), (F.col("so_far") * F.col("confidence")).alias("confidence"),
            F.array_append("ords", F.col("seq").cast("long")).alias("ords"),
        )
        found = level.withColumn("hops", F.lit(hop)) if found is None else found.unionByName(level.withColumn("hops", F.lit(hop)))
    q = W.partitionBy("query_id")
    first = found.withColumn("_b", F.row_number().over(q.orderBy("hops", "ords"))).where(F.col("_b") <= limit)
    return first.withColumn("rank", F.row_number().over(q.orderBy("hops", F.round("confidence", 9).desc(), "_b"))).select("query_id", "path", "confidence", "hops", "rank")


def graph_ranked(hits: DataFrame, paths: DataFrame, evidence: DataFrame, k: int = 3, decay: float = 0.82) -> DataFrame:
    """Merge graph targets into ranked hits (query_id, document_id, score, rank).

    A target's score is its seed's times the path's confidence times decay^hops; the best path of each target stays, and only targets with
    evidence (query_id, document_id). Order: first hit, targets by score, other hits; distinct documents; the first k.
    """
    seed = hits.select("query_id", F.col("document_id").alias("_seed"), F.col("score").alias("_s"))
    best = paths.withColumn("_seed", F.element_at("path", 1)).withColumn("document_id", F.element_at("path", -1)).join(seed, ["query_id", "_seed"])
    best = best.withColumn("score", F.round(F.col("_s") * F.col("confidence") * F.pow(F.lit(decay), F.col("hops")), 6))
    w = W.partitionBy("query_id", "document_id").orderBy(F.desc("score"), "rank")
    best = best.withColumn("_n", F.row_number().over(w)).where("_n = 1").join(evidence.select("query_id", "document_id").distinct(), ["query_id", "document_id"], "left_semi")
    a = hits.where("rank = 1").select("query_id", "document_id", "score", F.lit("hit").alias("mode"), F.lit(0).alias("bucket"), "rank")
    b = best.select("query_id", "document_id", "score", F.lit("graph").alias("mode"), F.lit(1).alias("bucket"), "rank")
    c = hits.where("rank > 1").select("query_id", "document_id", "score", F.lit("hit").alias("mode"), F.lit(2).alias("bucket"), "rank")
    every = a.unionByName(b).unionByName(c)
    order = [F.col("bucket"), F.when(F.col("bucket") == 1, -F.col("score")).otherwise(0.0), F.col("rank"), F.col("document_id")]
    once = every.withColumn("_n", F.row_number().over(W.partitionBy("query_id", "document_id").orderBy(*order))).where("_n = 1")
    return once.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("place") <= k).select("query_id", "document_id", "score", "mode", "place")


def rare_terms(docs: DataFrame, key: str = "doc_id", text: str = "content", least: int = 2, most: int = 20, length: int = 5) -> DataFrame:
    """key, entity: tokens of at least `length` characters that occur in `least` to `most` documents.

    The bound on documents is the operator's definition of an entity: it also bounds every later self-join.
    """
    each = docs.select(key, F.explode(F.array_distinct(T.retrieval_tokens(F.col(text)))).alias("entity")).where(F.length("entity") >= length)
    spread = each.groupBy("entity").agg(F.count(F.lit(1)).alias("df")).where(F.col("df").between(least, most))
    return each.join(spread.select("entity"), "entity", "left_semi").select(key, "entity")


def shared_entity_edges(members: DataFrame, key: str = "doc_id", neighbours: int = 3) -> DataFrame:
    """source, target, shared: for each document the documents with most entities in common (`members`: key, entity)."""
    other = members.select(F.col(key).alias("target"), "entity")
    pairs = members.withColumnRenamed(key, "source").join(other, "entity").where("source <> target").groupBy("source", "target").agg(F.count(F.lit(1)).alias("shared"))
    w = W.partitionBy("source").orderBy(F.desc("shared"), "target")
    return pairs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= neighbours)


def hyperedges(members: DataFrame, seeds: DataFrame, hops: int = 1, key: str = "doc_id") -> DataFrame:
    """key, hop: events reached from `seeds` over shared entities, with the first hop; seeds are hop 0."""
    seen = seeds.select(key).distinct().withColumn("hop", F.lit(0))
    front = seen.select(key)
    for hop in range(1, hops + 1):
        entities = members.join(front, key, "left_semi").select("entity").distinct()
        near = members.join(entities, "entity", "left_semi").select(key).distinct()
        front = near.join(seen.select(key), key, "left_anti")
        seen = seen.unionByName(front.withColumn("hop", F.lit(hop)))
    return seen


def references(docs: DataFrame, pattern: str = r"doc-[0-9]+", key: str = "document_id", text: str = "content", around: int = 110) -> DataFrame:
    """source_id, target_id, anchor: ids of other documents that a text names, once each, with the text about the first place."""
    said = docs.select(F.col(key).alias("source_id"), F.col(text).alias("body"), F.explode(F.array_distinct(F.transform(T.found(F.col(text), "(?i)" + pattern), F.lower))).alias("target_id"))
    known = docs.select(F.lower(key).alias("target_id"))
    return said.join(known, "target_id", "left_semi").where("lower(source_id) <> target_id").select(
        "source_id", "target_id", F.expr(f"substring(body, greatest(1, locate(target_id, lower(body)) - {around}), length(target_id) + least({around}, locate(target_id, lower(body)) - 1) + {around})").alias("anchor"),
    )
