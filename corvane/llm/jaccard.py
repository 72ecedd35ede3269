"""An exact set-similarity join: links between texts whose word shingles have a Jaccard similarity of at least `least`.

A text's set holds the XXH64 values of its shingles. Under any total order of the shingles two sets of that similarity share one of each one's
first size - ceil(least * size) + 1, so only those are dealt out and met by equal shingle; sizes that can't reach the similarity are passed over. The
order is by the number of texts that hold a shingle, counted over all of them, so a text is met by its rarest ones; those it holds alone, met by no
other, come first and leave most texts without any. For the counts the shingles are dealt out by hash, packed in six bytes, and only shared ones return.

Links are wanted only as far as they connect, so not every pair of a large group is needed:
    given   pairs found otherwise (by fingerprints) are verified first;
    twice   each text meets one holder of another component: the first holder of a shingle that it shares most shingles with;
    then    all holders of a shingle that are not yet in one component meet: as pairs where they are few, else in blocks of bounded size, of which only links leave a task.
Each pair is verified by its whole sets, read from the texts. A group of near copies costs a few rows a text; no pair is capped or left out.

Equal texts are one text (by a 64-bit hash). A text without words is equal to others without words and to no other.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import bounded_batches, materialize, release
from corvane.llm.components import components
from corvane.llm.simhash import majority, shingle_hashes

#: Texts whose shingles travel together, 256 at most: one byte tells which of them holds a shingle.
SAMPLE = 256
#: Characters of text to a part of the shingles, which a task holds whole.
PART = 2**24
#: Rounds in which each text meets one holder only.
ROUNDS = 2
#: Holders of a shingle up to which they meet as pairs, at most sixteen a holder.
FEW = 32
#: Holders of any other shingle in a block; two blocks are in a task's memory at once.
BLOCK = 512


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    return np.unique(shingle_hashes(text, words).view(np.int64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if len(a) or len(b) else 1.0


def dealt(texts: DataFrame, words: int, parts: int) -> DataFrame:
    """(part, unit, at, tokens, keys, sizes, codes): the shingles of up to `SAMPLE` texts (a unit, named by its first key) that fall in a part.

    A token is a hash's lower 40 bits; `at` has a byte for each: which text of the unit holds it. One row of a unit has its texts' keys, sizes and fingerprints."""
    spark = texts.sparkSession
    bounded_batches(spark)
    unit = min(SAMPLE, 256)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, unit):
                some = b.slice(start, unit)
                keys = some.column(0).to_numpy(zero_copy_only=False)
                hashes = [shingle_hashes(t, words) for t in some.column(1).to_pylist()]
                codes = np.array([majority(h) for h in hashes], np.uint64)
                sets = [np.unique(h) for h in hashes]
                sizes = np.array([len(x) for x in sets], np.int32)
                every = np.concatenate(sets)
                part = ((every >> np.uint64(40)) % np.uint64(parts)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                here, first = np.unique(part[order], return_index=True)
                if not len(here):
                    here, first = np.zeros(1, np.int32), np.zeros(1, np.int64)
                ends = np.append(first, len(every)).astype(np.int32)
                tokens = every[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
                at = np.repeat(np.arange(len(sets), dtype=np.uint8), sizes)[order].tobytes()
                home = int(keys[0]) % len(here)
                once = [pa.array([x.tobytes() if k == home else None for k in range(len(here))], pa.binary()) for x in (keys, sizes, codes)]
                yield pa.RecordBatch.from_arrays([pa.array(here), pa.array(np.full(len(here), keys[0])), _binary(at, ends), _binary(tokens, ends * 5), *once], ["part", "unit", "at", "tokens", "keys", "sizes", "codes"])

    return texts.select("key", "text").mapInArrow(work, "part int, unit long, at binary, tokens binary, keys binary, sizes binary, codes binary")


def _binary(data: bytes, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data)])


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), kind)


def _held_by_several(rows: pa.Table) -> pa.Table:
    """Of a part's shingles those that several texts hold, as 64-bit tokens with their number of holders (65535 stands for more)."""
    part = rows.column("part")[0].as_py()
    at = _joined(rows.column("at"), "u1")
    wide = np.zeros((len(at), 8), np.uint8)
    wide[:, :5] = _joined(rows.column("tokens"), "u1").reshape(-1, 5)
    tokens = wide.view("<i8").ravel()
    order = np.argsort(tokens)
    new = np.flatnonzero(np.diff(tokens[order], prepend=-1))
    counts = np.empty(len(at), np.uint16)
    n = np.diff(new, append=len(at))
    counts[order] = np.repeat(np.minimum(n, 65535).astype(np.uint16), n)
    some = counts > 1
    row = np.repeat(np.arange(rows.num_rows), [len(x) if x else 0 for x in rows.column("at").to_pylist()])
    ends = np.append(0, np.cumsum(np.bincount(row[some], minlength=rows.num_rows)))
    out = pa.table({
        "unit": rows.column("unit"), "at": _binary(at[some].tobytes(), ends), "tokens": _binary((tokens[some] | part << 40).tobytes(), ends * 8), "counts": _binary(counts[some].tobytes(), ends * 2),
        **{c: rows.column(c) for c in ("keys", "sizes", "codes")},
    })
    return out.filter(pa.array((np.diff(ends) > 0) | (rows.column("keys").is_valid().to_numpy())))


def prefix(size: int, shared: np.ndarray, least: float) -> np.ndarray:
    """Of a set's first size - ceil(least * size) + 1 shingles those in `shared`, which are in order and stand behind the others."""
    if not size:
        return np.zeros(1, np.int64)
    return shared[: max(0, len(shared) - math.ceil(least * size - 1e-9) + 1)]


def heads(texts: DataFrame, least: float, words: int) -> DataFrame:
    """(key, size, code, firsts) of each of the distinct texts (key, text): the size of its set, its fingerprint, and the shingles it is met by."""
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // PART))

    def firsts(rows: pa.Table) -> pa.Table:
        keys, sizes, codes = (_joined(rows.column(c), kind) for c, kind in (("keys", "i8"), ("sizes", "i4"), ("codes", "i8")))
        at, tokens, counts = (_joined(rows.column(c), kind) for c, kind in (("at", "u1"), ("tokens", "i8"), ("counts", "u2")))
        order = np.lexsort((tokens, counts, at))
        ends = np.searchsorted(at[order], np.arange(len(keys) + 1))
        tokens = tokens[order]
        own = [prefix(n, tokens[a:b], least) for n, a, b in zip(sizes.tolist(), ends[:-1].tolist(), ends[1:].tolist())]
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, own)]), pa.int32()), pa.array(np.concatenate(own)))
        return pa.table({"key": keys, "size": sizes, "code": codes, "firsts": lists})

    held = "unit long, at binary, tokens binary, counts binary, keys binary, sizes binary, codes binary"
    several = dealt(texts, words, parts).groupBy("part").applyInArrow(_held_by_several, held)
    return several.groupBy("unit").applyInArrow(firsts, "key long, size int, code long, firsts array<long>")


def verified(pairs: DataFrame, held: DataFrame, least: float, words: int) -> DataFrame:
    """Those of the pairs of keys (a, b) whose texts, of `held` (key, text), reach the similarity."""
    met = pairs.join(held.select(F.col("key").alias("b"), F.col("text").alias("right")), "b").join(held.select(F.col("key").alias("a"), F.col("text").alias("left")), "a")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, np.zeros(0, np.int64)
        for batch in batches:
            good = []
            for a, left, right in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                if a != last:
                    last, own = a, shingles(left, words)
                good.append(similarity(own, shingles(right, words)) >= least - 1e-12)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in (batch.column(0), batch.column(1))], ["a", "b"])

    return materialize(met.select("a", "b", "left", "right").mapInArrow(work, "a long, b long"), "jaccard-links")


def connected(texts: DataFrame, heads: DataFrame, close: DataFrame, least: float = 0.8, words: int = 5) -> DataFrame:
    """(code, doc): each key that has a link, and the smallest key of its component. `close` (a, b) are pairs of keys likely to be alike. The tables `texts` and `heads` are deleted once read."""
    ordered = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    near = lambda x, y: F.least(x, y) >= F.greatest(x, y) * (least - 1e-12)
    tried = materialize(close.select(*ordered("a", "b")).distinct(), "jaccard-close")
    rows = heads.select(F.explode("firsts").alias("token"), "key", "size")
    several = materialize(rows.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("token"), "jaccard-several")
    shared = materialize(rows.join(several, "token"), "jaccard-shared")
    release(several)
    needed = shared.select("key").unionByName(tried.select(F.col("a").alias("key"))).unionByName(tried.select(F.col("b").alias("key"))).distinct()
    held = materialize(texts.join(needed, "key", "left_semi"), "jaccard-texts")
    keys = materialize(heads.select(F.col("key").alias("code"), F.col("key").alias("doc")), "jaccard-keys")
    release(heads, texts)

    links = verified(tried, held, least, words)
    label = components(keys, links)
    told = lambda: shared.join(label.select(F.col("code").alias("key"), F.col("doc").alias("label")), "key", "left").withColumn("label", F.coalesce("label", "key"))
    for _ in range(ROUNDS):
        now = materialize(told(), "jaccard-told")
        low = now.groupBy("token").agg(F.min(F.struct("label", "key", "size")).alias("low"), F.max("label").alias("high")).where(F.col("low.label") < F.col("high")).select("token", "low")
        low = materialize(low, "jaccard-low")
        star = now.join(low, "token").where((F.col("label") != F.col("low.label")) & near(F.col("size"), F.col("low.size")))
        star = star.groupBy("key", F.col("low.key").alias("other")).agg(F.count(F.lit(1)).alias("n"))
        one = star.groupBy("key").agg(F.max_by("other", F.struct("n", "other")).alias("other")).select(*ordered("key", "other")).distinct()
        one = materialize(one.join(tried, ["a", "b"], "left_anti"), "jaccard-pairs")
        release(now, low)
        if one.isEmpty():
            break
        more = verified(one, held, least, words)
        tried = tried.unionByName(one)
        if not more.isEmpty():
            links = links.unionByName(more)
            label = components(keys, links)

    # what is left apart: the holders of a shingle that few hold meet as pairs, those of other shingles block by block, and only links leave a task
    now = materialize(told(), "jaccard-told")
    mixed = now.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("token", "n")
    # written before the join: both of its sides are then plain shuffles, whose large partitions (a shingle of many) Spark may split
    apart = materialize(mixed, "jaccard-apart")
    mixed = materialize(now.join(apart, "token"), "jaccard-mixed")
    release(apart)
    few, many = mixed.where(F.col("n") <= FEW), mixed.where(F.col("n") > FEW)
    left, right = (few.select("token", *[F.col(c).alias(f"{c}_{side}") for c in ("key", "size", "label")]) for side in "xy")
    rest = left.join(right, "token").where((F.col("label_x") < F.col("label_y")) & near(F.col("size_x"), F.col("size_y")))
    rest = materialize(rest.select(*ordered("key_x", "key_y")).distinct().join(tried, ["a", "b"], "left_anti"), "jaccard-pairs")
    release(now, shared)
    more = verified(rest, held, least, words)
    release(rest)
    if not many.isEmpty():
        tokens = many.groupBy("key").agg(F.sort_array(F.collect_set("token")).alias("tokens"))  # at most a text's first shingles
        sets = materialize(held.join(tokens, "key").mapInArrow(_sets(words), "key long, tokens array<long>, shingles array<long>"), "jaccard-sets")
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        dealt = many.select("token", "key", "label", F.pmod(F.xxhash64("key"), blocks).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        dealt = dealt.select("token", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "key", "label", "own").join(sets, "key")
        found = dealt.groupBy("token", "low", "high").applyInPandas(lambda key, rows: _block_links(key, rows, least), "a long, b long")
        found = materialize(found.distinct(), "jaccard-links")
        release(sets)
        more = more.unionByName(found)
    release(mixed, held)
    return label if more.isEmpty() else components(keys, links.unionByName(more))


def _sets(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, words) for t in b.column("text").to_pylist()]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("tokens"), lists], ["key", "tokens", "shingles"])

    return work


def _block_links(group: tuple, rows: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links that connect what is alike in a block, or between two blocks, of a shingle's holders; those already connected are passed over.

    A pair that shares several of the shingles is compared for the smallest alone."""
    token, low, high = group
    rows = rows.sort_values(["own", "key"], ignore_index=True)
    keys, labels, own = rows["key"].tolist(), rows["label"].tolist(), rows["own"].tolist()
    sets, tokens = [np.asarray(x) for x in rows["shingles"]], [np.asarray(x) for x in rows["tokens"]]
    sizes = np.array([len(x) for x in sets])
    at: dict[int, int] = {}

    def root(x: int) -> int:
        while at.setdefault(x, x) != x:
            at[x] = at[at[x]]
            x = at[x]
        return x

    out = []
    for i in range(len(keys)):
        if low != high and own[i] == high:
            break
        later = np.arange(i + 1, len(keys))
        for j in later[np.minimum(sizes[later], sizes[i]) >= np.maximum(sizes[later], sizes[i]) * (least - 1e-12)].tolist():
            if (low != high and own[j] == low) or root(labels[i]) == root(labels[j]):
                continue
            common = np.intersect1d(tokens[i], tokens[j], assume_unique=True)
            if common[0] == token and similarity(sets[i], sets[j]) >= least - 1e-12:
                out.append((min(keys[i], keys[j]), max(keys[i], keys[j])))
                at[root(labels[i])] = root(labels[j])
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")
