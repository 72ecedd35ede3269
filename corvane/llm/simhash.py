"""SimHash near-dedup by covering locality-sensitive hashing.

A text's fingerprint takes, bit by bit, the majority over the XXH64 values of its word shingles. Two fingerprints are
linked when they differ in at most `radius` bits; groups are the connected components of those links.

Search: position i of the 64 gets a non-zero vector phi(i) in F_2^(radius+1); table v (every non-zero v) keeps the
bits with <phi(i), v> = 1. At most `radius` differing positions span a proper subspace, so some v is orthogonal to all of
them: every pair within the radius agrees on every kept bit of some table. No pair is missed, whatever the data.

Within a bucket nothing is quadratic: small buckets (at most `SMALL_BUCKET` distinct fingerprints) compare their members; in
larger ones two members are linked when they share a code that is at most one flip away from both (radius 1: one of them is that
code), which is the same relation, and at most 65 fingerprints can share such a code.

Copies collapse to one fingerprint before any search, so a group of equal texts costs one row per text.

Nulls: a null text is the empty text (fingerprint zero, linked like any other); a null id keeps its row and is ignored by
the minimum, so a group of only null ids has a null component. Repeated rows yield repeated result rows. Empty tables
yield empty results. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import bounded_batches, materialize, plus, release, shuffles_dropped
from corvane.llm.components import components

#: Distinct fingerprints up to which a bucket's members are compared one by one.
SMALL_BUCKET = 24


def shingle_hashes(text: str | None, words: int = 3, seed: int = 42) -> np.ndarray:
    """The XXH64 values of the text's shingles, in order, repeats included; a shorter text is one shingle, a text without words has none."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    line, n, digest = b" ".join(tokens), max(1, len(tokens) - words + 1), xxhash.xxh64_intdigest
    if n == 1:
        return np.array([digest(line, seed)], dtype=np.uint64)
    at = np.zeros(len(tokens) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in tokens], out=at[1:])
    return np.fromiter((digest(line[a:b], seed) for a, b in zip(at[:n].tolist(), (at[words : words + n] - 1).tolist())), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are those set in over half of the hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for part in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[part : part + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    return majority(shingle_hashes(text, words, seed))


def with_fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint", words: int = 3, seed: int = 42) -> DataFrame:
    """All columns of `docs` and the fingerprint as a signed long in `out` (a column of that name is replaced)."""
    bounded_batches(docs.sparkSession)
    rest = docs.drop(out) if out in docs.columns else docs

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = np.array([fingerprint(t, words, seed) for t in b.column(text).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(codes.view(np.int64))], [*b.schema.names, out])

    return rest.mapInArrow(add, plus(rest, **{out: "long"}))


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """The 2^(radius+1)-1 masks, as signed longs; bit i belongs to mask v when <phi(i), v> is odd."""
    n = 2 ** (radius + 1) - 1
    masks = []
    for v in range(1, n + 1):
        m = sum(1 << i for i in range(bits) if bin((i % n + 1) & v).count("1") % 2)
        masks.append(m - (1 << 64) if m >> 63 else m)
    return masks


def links(codes: DataFrame, radius: int = 2, small: int = SMALL_BUCKET) -> DataFrame:
    """Links (a, b), a < b, of distinct fingerprints `code` within `radius` bits; connected exactly as all such pairs are.

    Small buckets give every pair within the radius. In larger ones members that share a midpoint are linked to its smallest member (radius 2) or to the
    member that is the midpoint (radius 1), so the components are those of all pairs, though not every pair is a row. `small` changes no component.
    """
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2")
    masks = covering_masks(radius)
    tables = F.array(*[F.struct(F.lit(v).alias("tab"), F.col("code").bitwiseAND(F.lit(m)).alias("key")) for v, m in enumerate(masks)])
    dealt = codes.select("code", F.explode(tables).alias("t")).select("t.tab", "t.key", "code")
    sizes = dealt.groupBy("tab", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    crowded = materialize(dealt.join(sizes, ["tab", "key"]), "simhash-buckets")

    members = crowded.where(F.col("n") <= small).groupBy("tab", "key").agg(F.sort_array(F.collect_list("code")).alias("m"))
    near = members.select(F.explode(F.expr(f"""
        flatten(transform(m, (x, i) -> transform(
            filter(slice(m, i + 2, {small}), y -> bit_count(x ^ y) <= {radius}), y -> struct(x AS a, y AS b))))""")).alias("p"))
    direct = near.select("p.a", "p.b")

    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i).cast("long") for i in range(64)])
    unmasked = F.element_at(F.array(*[F.lit(m) for m in masks]), F.col("tab") + 1)
    around = (
        crowded.where(F.col("n") > small)
        .select("tab", "key", "code", F.explode(flips).alias("flip"), unmasked.alias("mask"))
        .where(F.col("flip").bitwiseAND(F.col("mask")) == 0)
        .select("tab", "code", F.col("code").bitwiseXOR(F.col("flip")).alias("mid"))
    )
    met = around.groupBy("tab", "mid").agg(F.sort_array(F.collect_list("code")).alias("m")).where(F.size("m") > 1)
    if radius == 2:  # all that share a midpoint are within two flips of each other
        star = met.select(F.expr("m[0]").alias("hub"), F.explode(F.expr("slice(m, 2, size(m))")).alias("code"))
    else:  # within one flip of each other are only a member that is the midpoint itself and each of the others
        star = met.where(F.array_contains("m", F.col("mid"))).select(F.col("mid").alias("hub"), F.explode(F.array_remove("m", F.col("mid"))).alias("code")).where(F.lit(radius == 1))
    stars = star.select(F.least("hub", "code").alias("a"), F.greatest("hub", "code").alias("b"))
    return direct.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 2, words: int = 3, seed: int = 42) -> DataFrame:
    """One row per row of `docs`: doc_id, code (signed fingerprint), component_id (smallest id reachable, itself included)."""
    ids = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = materialize(with_fingerprints(ids, "text", "code", words, seed).select("doc_id", "code"), "simhash-codes")
    nodes = materialize(prints.groupBy("code").agg(F.min("doc_id").alias("doc")), "simhash-nodes")
    found = components(nodes, links(nodes.select("code"), radius))
    # written before the join: both of its sides are then plain shuffles, whose large partitions (one code of many copies) Spark may split
    lowest = materialize(nodes.join(found.withColumnRenamed("doc", "low"), "code", "left").select("code", F.coalesce("low", "doc").alias("component_id")), "simhash-lowest")
    return prints.join(lowest, "code").select("doc_id", "code", "component_id")


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, least: float = 0.8, words: int = 5, radius: int = 2) -> DataFrame:
    """One row per row of `docs`: doc_id, key (hash of the text), component_id and first_key.

    Texts are linked when the Jaccard similarity of their word shingles is at least `least`. Pairs within `radius` bits of each other's fingerprints are
    found by the covering masks and verified first; a similarity of 0.8 leaves some ten of 64 bits unlike, which no number of tables reaches at this selectivity, so
    the links beyond the radius are found by an exact set-similarity join (jaccard.py). A component's first row has its smallest id and,
    of that id's texts, the smallest key: (component_id, first_key). Null ids come last; a null text is the empty text.
    """
    from corvane.llm import jaccard

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    with shuffles_dropped(docs.sparkSession):
        texts = materialize(rows.select("key", "text").dropDuplicates(["key"]), "simhash-texts")
        heads = materialize(jaccard.heads(texts, least, words), "simhash-heads")
        owner = materialize(heads.groupBy("code").agg(F.min("key").alias("key")), "simhash-owners")
        # each fingerprint is verified with the smallest one linked to it; what that leaves apart the set join finds
        close = links(owner.select("code"), radius).groupBy("b").agg(F.min("a").alias("a"))
        between = close.join(owner.select(F.col("code").alias("a"), F.col("key").alias("x")), "a").join(owner.select(F.col("code").alias("b"), F.col("key").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        within = heads.select("code", F.col("key").alias("b")).join(owner.select("code", F.col("key").alias("a")), "code").where("a <> b").select("a", "b")
        found = jaccard.connected(texts, heads, between.unionByName(within), least, words)
        release(owner)
        ids = materialize(rows.select("doc_id", "key"), "simhash-ids")
        label = found.select(F.col("code").alias("key"), F.col("doc").alias("root"))
        ids = ids.join(label, "key", "left").withColumn("root", F.coalesce("root", "key"))
        first = ids.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("low"))
        first = materialize(first.select("root", F.col("low.doc_id").alias("component_id"), F.col("low.key").alias("first_key")), "simhash-first")
    return ids.join(first, "root").select("doc_id", "key", "component_id", "first_key")
