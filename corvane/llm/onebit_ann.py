"""Approximate nearest neighbours by randomly rotated one-bit codes.

Index. A vector, less the sample's mean, is scaled to unit length and turned by a seeded random rotation; its code is the sign of each
place, packed into bits. Two scalars correct estimates: its distance from the mean, and the inner product of the unit vector
with its own code. Vectors lie ordered by the nearest of some centres fitted to the sample, which deals a crowded cell over many tasks.

Estimates. A query is treated alike, but each place is rounded to `PLANES` bits, one bit plane for each. Counting the bits that a code and each plane have in common gives
<code, query>, and <code, query> / <code, vector> estimates the inner product of query and vector. It lies within e * sqrt((1 - q^2) / q^2 / (d - 1)) of it, q being the second
scalar, with a probability that e sets (e = 3: more than 99 %); the rounding adds e times its own error.

Search. Queries come in blocks of bounded size that travel to the tasks; vectors stay where they are and are never shuffled again. A query begins with its k-th distance within the sample as its
limit. A stretch of a cell is passed over for a query if the triangle inequality puts all of it beyond the limit; elsewhere lower bounds come from the estimates, the lowest are reranked
by exact distances first, and then all others still below the limit. Each task returns k rows a query at most, and one window by query merges them. Every row is indexed and can
be found; mean, centres and first limits come from at most `sample` vectors (smallest keyed hash first) and affect only speed and the width of bounds.

Nulls: vectors that are null, zero, or hold nulls, NaN or infinities take no part; rows with a null id neither. Vectors of different lengths have no distance: each length is a search of its own.
Every row is a candidate, repeated ones too, but those with the query's own id; equal rows among the queries ask once, different vectors of one id ask for themselves.
Ties go to the smaller id. With fewer than k candidates all are returned; without vectors, nothing. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm.common import bounded_batches, materialize, release

#: Bits of a query's places.
PLANES = 6
#: Rows of a stretch that is compared at once, and queries with it.
ROWS, TOGETHER = 8192, 64
#: Numbers in a block of queries or in the sample at most: 64 MB.
NUMBERS = 1 << 23


def rotation(d: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    wide = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), bool)
    wide[:, : bits.shape[1]] = bits
    return np.packbits(wide, axis=1).view(np.uint64)


class Codec:
    def __init__(self, mean: np.ndarray, seed: int = 10):
        self.mean, self.turn = mean, rotation(len(mean), seed)

    def rotated(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances from the mean, and the rotated unit vectors (zero for the mean itself)."""
        away = x - self.mean
        size = np.sqrt((away * away).sum(axis=1))
        return size, (away / np.where(size > 0, size, 1.0)[:, None]) @ self.turn

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed signs (64-bit words), distance from the mean, and the inner product of each unit vector with its code."""
        size, unit = self.rotated(x)
        return _words(unit > 0), size, np.abs(unit).sum(axis=1) / math.sqrt(x.shape[1])


@dataclass
class Asked:
    """Queries as the estimates need them: bit planes, and what undoes the rounding."""

    size: np.ndarray
    planes: np.ndarray  # query, plane, word
    low: np.ndarray
    step: np.ndarray
    total: np.ndarray
    error: np.ndarray

    @classmethod
    def of(cls, codec: Codec, q: np.ndarray) -> Asked:
        size, unit = codec.rotated(q)
        low = unit.min(axis=1)
        step = np.maximum((unit.max(axis=1) - low) / (2**PLANES - 1), 1e-300)
        u = np.clip(np.rint((unit - low[:, None]) / step[:, None]), 0, 2**PLANES - 1).astype(np.int64)
        planes = np.stack([_words((u >> j) & 1 > 0) for j in range(PLANES)], axis=1)
        error = np.sqrt(((unit - low[:, None] - step[:, None] * u) ** 2).sum(axis=1))
        return cls(size, planes, low, step, u.sum(axis=1), error)

    def products(self, which: np.ndarray, codes: np.ndarray, d: int) -> np.ndarray:
        """<code, query> for codes of unit length, from the bits in common; a row for each of the queries `which`."""
        ones = np.bitwise_count(codes).sum(axis=1).astype(np.float64)
        both = np.zeros((len(which), len(codes)))
        for j in range(PLANES):
            for w in range(codes.shape[1]):
                both += np.bitwise_count(codes[:, w][None, :] & self.planes[which, j, w][:, None]).astype(np.float64) * 2.0**j
        low, step = self.low[which][:, None], self.step[which][:, None]
        return (2 * low * ones + 2 * step * both - low * d - step * self.total[which][:, None]) / math.sqrt(d)


def usable(vectors: DataFrame, vec_id: str, column: str) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    return rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))


def centres(x: np.ndarray, n: int, seed: int, rounds: int = 5) -> np.ndarray:
    """n centres of the rows of x, by a few rounds of k-means."""
    c = x[np.random.default_rng(seed).choice(len(x), n, replace=False)]
    for _ in range(rounds):
        at = _nearest_centre(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        n_at = np.bincount(at, minlength=n)
        c = np.where(n_at[:, None] > 0, sums / np.maximum(n_at, 1)[:, None], c)
    return c


def _nearest_centre(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1) - 2 * (x @ c.T)).argmin(axis=1)


def _exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of the rows of x from q; squares are added from the first place to the last, so they don't depend on how many rows are taken together."""
    away = x - q
    return np.sqrt(np.add.accumulate(away * away, axis=1)[:, -1])


def _matrix(column: pa.ListArray, d: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, d)


INDEX = "vec_id long, v array<double>, cell int, code binary, size double, own double"


def index(vectors: DataFrame, codec: Codec, cells: np.ndarray) -> DataFrame:
    """The index rows of all vectors (vec_id, v), in the order of their cells; a cell's rows are spread by id."""
    d = len(codec.mean)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1), d)
                code, size, own = codec.encode(x)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(_nearest_centre(x, cells), pa.int32()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(size), pa.array(own)],
                    ["vec_id", "v", "cell", "code", "size", "own"],
                )

    coded = vectors.select("vec_id", "v").mapInArrow(work, INDEX)
    return coded.withColumn("spread", F.xxhash64("vec_id")).repartitionByRange("cell", "spread").sortWithinPartitions("cell", "spread").drop("spread")


class Searcher:
    """A block of queries, and what a task has found for each of them."""

    def __init__(self, codec: Codec, cells: np.ndarray, ids: np.ndarray, q: np.ndarray, limit: np.ndarray, k: int, e: float):
        self.codec, self.cells, self.ids, self.q, self.limit, self.k, self.e = codec, cells, ids, q, limit.copy(), k, e
        self.asked, self.best = Asked.of(codec, q), [(np.empty(0), np.empty(0, np.int64)) for _ in ids]
        self.to_cell = np.sqrt(np.maximum(((q[:, None, :] - cells[None]) ** 2).sum(axis=2), 0)) if q.size * len(cells) <= NUMBERS else np.stack([np.sqrt(((q - c) ** 2).sum(axis=1)) for c in cells], axis=1)

    def look(self, cell: int, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, size: np.ndarray, own: np.ndarray) -> None:
        """Compare a stretch of one cell."""
        d = x.shape[1]
        reach = float(np.sqrt(((x - self.cells[cell]) ** 2).sum(axis=1)).max())
        near = np.nonzero(self.to_cell[:, cell] - reach <= self.limit * (1 + 1e-9) + 1e-9)[0]
        own = np.maximum(own, 1e-9)
        slack = self.e * np.sqrt(np.maximum(1 - own * own, 0) / (own * own) / max(d - 1, 1))
        for at in range(0, len(near), TOGETHER):
            which = near[at : at + TOGETHER]
            about = self.asked.products(which, codes, d) / own
            close = np.minimum(about + slack + self.e * self.asked.error[which][:, None] / math.sqrt(d) / own, 1.0)
            far = self.asked.size[which][:, None]
            bound = far**2 + size**2 - 2 * far * size * close
            open_ = bound <= (self.limit[which] ** 2 * (1 + 1e-9) + 1e-9)[:, None]
            for row in np.nonzero(open_.any(axis=1))[0]:
                self._rerank(int(which[row]), ids, x, bound[row], np.nonzero(open_[row])[0])

    def _rerank(self, qi: int, ids: np.ndarray, x: np.ndarray, bound: np.ndarray, rows: np.ndarray) -> None:
        rows = rows[ids[rows] != self.ids[qi]]
        rows = rows[np.argsort(bound[rows], kind="stable")]
        done, take = 0, 4 * self.k
        while done < len(rows) and bound[rows[done]] <= self.limit[qi] ** 2 * (1 + 1e-9) + 1e-9:
            some = rows[done : done + take]
            done, take = done + len(some), take * 4
            dist, who = (np.concatenate(c) for c in zip(self.best[qi], (_exact(x[some], self.q[qi]), ids[some])))
            keep = np.lexsort((who, dist))[: self.k]
            self.best[qi] = dist[keep], who[keep]
            if len(keep) == self.k:
                self.limit[qi] = min(self.limit[qi], dist[keep[-1]])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the query, id, distance) of all rows found."""
        n = np.repeat(np.arange(len(self.best)), [len(d) for d, _ in self.best])
        return n, np.concatenate([w for _, w in self.best] or [np.empty(0, np.int64)]), np.concatenate([d for d, _ in self.best] or [np.empty(0)])


def first_limits(ids: np.ndarray, q: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th distance within the sample, rows of its own id left out; infinite if there are fewer."""
    out, squares = np.full(len(q), np.inf), (sample * sample).sum(axis=1)
    for at in range(0, len(q), 256):
        part = q[at : at + 256]
        d = squares + (part * part).sum(axis=1)[:, None] - 2 * (part @ sample.T)
        d[sample_ids[None, :] == ids[at : at + 256, None]] = np.inf
        if d.shape[1] >= k:
            # the room covers the rounding of this shorter formula
            scale = squares.max() + (part * part).sum(axis=1)
            out[at : at + 256] = np.sqrt(np.maximum(np.partition(d, k - 1, axis=1)[:, k - 1], 0) + 1e-9 * scale)
    return out


FOUND = "query_id long, spot long, vec_id long, score double"


def _search_length(rows: DataFrame, queries: DataFrame, d: int, n: int, k: int, e: float, sample: int, seed: int, query_block: int, rows_a_cell: int) -> list[DataFrame]:
    """Per block of queries: the nearest rows that each task found. All vectors have length d."""
    spark = rows.sparkSession
    part = rows.select("vec_id", "v", F.xxhash64(F.lit(seed), "vec_id", "v").alias("h")).orderBy("h", "vec_id").limit(max(k + 1, min(sample, NUMBERS // d))).toArrow().combine_chunks()
    some_ids, some = np.asarray(part["vec_id"]), _matrix(part["v"].combine_chunks(), d)
    codec = Codec(some.mean(axis=0), seed)
    cells = centres(some, max(1, min(256, len(some) // 32, n // rows_a_cell)), seed)
    table = materialize(index(rows, codec, cells), "ann-index")
    asked = materialize(queries.withColumn("spot", F.xxhash64("v")).dropDuplicates(["vec_id", "spot"]), "ann-queries")
    blocks = max(1, math.ceil(asked.count() / max(1, min(query_block, NUMBERS // d))))
    out = []
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64(F.lit(seed), "vec_id", "spot"), F.lit(blocks)) == block).select("vec_id", "spot", "v").toArrow().combine_chunks()
        if not mine.num_rows:
            continue
        ids, spots, q = np.asarray(mine["vec_id"]), np.asarray(mine["spot"]), _matrix(mine["v"].combine_chunks(), d)
        sent = spark.sparkContext.broadcast((codec, cells, ids, q, first_limits(ids, q, some_ids, some, k), spots))

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            codec, cells, ids, q, limit, spots = sent.value
            searcher = Searcher(codec, cells, ids, q, limit, k, e)
            for b in _stretches(batches):
                cell = np.asarray(b["cell"])
                columns = np.asarray(b["vec_id"]), _matrix(b["v"].combine_chunks(), d), np.frombuffer(b"".join(b["code"].to_pylist()), np.uint64).reshape(len(cell), -1), np.asarray(b["size"]), np.asarray(b["own"])
                edges = np.concatenate([[0], np.nonzero(np.diff(cell))[0] + 1, [len(cell)]])
                for lo, hi in zip(edges[:-1], edges[1:]):
                    if lo < hi:
                        searcher.look(int(cell[lo]), *(c[lo:hi] for c in columns))
            which, who, far = searcher.found()
            yield pa.RecordBatch.from_arrays([pa.array(ids[which]), pa.array(spots[which]), pa.array(who), pa.array(far)], ["query_id", "spot", "vec_id", "score"])

        out.append(materialize(table.mapInArrow(work, FOUND), "ann-found"))
        sent.destroy()
    release(table, asked)
    return out


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to about ROWS rows."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= ROWS:
            yield pa.Table.from_batches(held)
            held = []
    if any(x.num_rows for x in held):
        yield pa.Table.from_batches(held)


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 10, *, vec_id: str = "vec_id", column: str = "embedding", e: float = 3.0, sample: int = 10_000,
    seed: int = 10, query_block: int = 4096, rows_a_cell: int = 512,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of `vectors` to each row of `queries`; score is the Euclidean distance."""
    bounded_batches(vectors.sparkSession)
    rows, asked = usable(vectors, vec_id, column), usable(queries, vec_id, column)
    found: list[DataFrame] = []
    for r in rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy("d").collect():
        same = F.size("v") == r["d"]
        found += _search_length(rows.where(same), asked.where(same), r["d"], r["n"], k, e, sample, seed, query_block, rows_a_cell)
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    met = found[0]
    for f in found[1:]:
        met = met.unionByName(f)
    place = F.row_number().over(W.partitionBy("query_id", "spot").orderBy("score", "vec_id"))
    return met.withColumn("rank", place.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
