"""Line dedup by pairwise alignment.

A document is the sequence of its lines with words (trimmed of ASCII white space); a block is a run of consecutive such lines with `block_words` words or more.
1. Candidates. From each line the shortest block that begins there and the shortest one that ends there are hashed. Any block two documents share
   is covered by such shortest blocks of it, so hashing these alone loses none. Each document meets the first holder of each of its block hashes: a
   passage of k documents costs k-1 meetings, however common its lines are, and no partner is left out.
2. Alignment. Only the lines in blocks shared with a partner are compared. Patience diff matches lines unique on both sides, keeps the longest increasing
   run of the matches, extends it over equal neighbours and aligns the gaps between; where a gap has no unique line, the n-th place of a line meets its n-th
   place. Aligned blocks are taken out of the later document and the rest is aligned again, so blocks moved or repeated are found as well.
3. Deletion. A line of the later document goes if it lies in a block that an earlier document holds; an empty line goes with the line above it.

Documents are ordered by id, then by a hash of the text. The first holder of a line has no earlier document to lose it to, so no line's last copy is lost.
The result is thus what comparing all pairs gives: a line goes exactly if a block around it stands in any earlier document.

Block hashes meet by an equi-join whose two sides are dealt by hash alone, so Spark can split the rows of a very common block over tasks; positions come with the hashes,
so the lines of a first holder are never copied to its partners. Texts meet the positions to delete in one join.

Nulls: a null text stays null; documents with a null id are neither earlier nor later than others and stay as they are. Rows of one id and one text are
one document and change nothing for each other; two texts of one id are two documents. Empty texts and tables stay
empty. A document may lose all its lines; it stays as an empty text. Further columns pass through.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import bounded_batches, materialize

#: ASCII white space but the line break.
BLANK = " \t\x0b\x0c\r"
_STEP, _CHECK = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched positions (i, j) of two sequences, both increasing, by patience diff."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        once_a, once_b = _once(a, a0, a1), _once(b, b0, b1)
        marks = _increasing([(i, once_b[h]) for h, i in once_a.items() if h in once_b])
        if not marks:
            nth_a, nth_b = _nth(a, a0, a1), _nth(b, b0, b1)
            marks = _increasing([(i, nth_b[h]) for h, i in nth_a.items() if h in nth_b])
            if not marks:
                continue
        out += marks
        cuts = [(a0 - 1, b0 - 1), *marks, (a1, b1)]
        todo += [(p + 1, i, q + 1, j) for (p, q), (i, j) in zip(cuts, cuts[1:])]
    return sorted(out)


def _once(x: list[int], lo: int, hi: int) -> dict[int, int]:
    """Value -> position of the values that occur once in x[lo:hi], by position."""
    at: dict[int, int] = {}
    for k in range(lo, hi):
        at[x[k]] = -1 if x[k] in at else k
    return {h: k for h, k in at.items() if k >= 0}


def _nth(x: list[int], lo: int, hi: int) -> dict[tuple[int, int], int]:
    """(value, how many of it before) -> position in x[lo:hi]."""
    seen: Counter[int] = Counter()
    at = {}
    for k in range(lo, hi):
        at[x[k], seen[x[k]]] = k
        seen[x[k]] += 1
    return at


def _increasing(matches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of `matches` (sorted by first) that also increases in the second."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(matches)
    for k, (_, j) in enumerate(matches):
        p = bisect_left(tails, j)
        before[k] = ends[p - 1] if p else -1
        if p == len(tails):
            tails.append(j)
            ends.append(k)
        else:
            tails[p], ends[p] = j, k
    run: list[tuple[int, int]] = []
    k = ends[-1] if ends else -1
    while k >= 0:
        run.append(matches[k])
        k = before[k]
    return run[::-1]


def common_blocks(earlier: list[int], later: list[int], words: list[int], least: int) -> list[int]:
    """Positions in `later` of the aligned common blocks of at least `least` words."""
    drop: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(earlier, later), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if sum(words[k] for k in block) >= least:
                drop += block
            block = []
        block.append(j)
        last = (i, j)
    return drop


def shortest_blocks(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the shortest blocks that begin, and of those that end, at each line; distinct, by first line."""
    total = np.concatenate([[0], np.cumsum(words)])
    n = len(words)
    begin = np.arange(n)
    end = np.searchsorted(total, total[:-1] + least)
    start = np.searchsorted(total, total[1:] - least, side="right") - 1
    a, b = np.concatenate([begin[end <= n], start[start >= 0]]), np.concatenate([end[end <= n], begin[start >= 0] + 1])
    both = np.unique(a * (n + 1) + b)
    return both // (n + 1), both % (n + 1)


def block_hashes(hashes: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each block of lines: the one is the key, the other tells false meetings apart."""
    out = []
    for step in (_STEP, _CHECK):
        powers, back = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(hashes), x, np.uint64)]), dtype=np.uint64) for x in (step, pow(int(step), -1, 2**64)))
        # sums of hash times power of the place, turned back by that of the first place (modulo 2^64)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(hashes.view(np.uint64), step) * powers[:-1], dtype=np.uint64)])
        out.append(_mixed((total[end] - total[first]) * back[first] + (end - first).astype(np.uint64), step).view(np.int64))
    return out[0], out[1]


def _mixed(x: np.ndarray, by: np.uint64) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * by
    return x ^ (x >> np.uint64(29))


def aligned_lines(hashes: np.ndarray, words: np.ndarray, partners: list[list[tuple[int, int, int]]], least: int) -> list[int]:
    """Lines the document loses. Each partner is a list of (first line here, its first line there, lines) of the blocks it shares."""
    first, end = shortest_blocks(words, least)
    places: dict[int, list[tuple[int, int]]] = {}
    key_of = {}
    for p, e, key in zip(first.tolist(), end.tolist(), block_hashes(hashes, first, end)[0].tolist()):
        places.setdefault(key, []).append((p, e))
        key_of[p, e] = key
    lines = hashes.tolist()
    gone: set[int] = set()
    for shared in partners:
        there = {q + k: lines[p + k] for p, q, n in shared for k in range(n)}
        mine = sorted({x for p, _, n in shared for x in places[key_of[p, p + n]]})
        left = {k for p, e in mine for k in range(p, e)}
        spots = sorted(left)
        number = {h: k for k, h in enumerate(dict.fromkeys(there.values()))}
        theirs: list[int] = []
        for x in sorted(there):
            if x - 1 not in there:
                theirs.append(-1)
            theirs.append(number[there[x]])
        seen: list[tuple[int, int]] = []  # lines here, with a break wherever some are left out
        for k in spots:
            if k - 1 not in left:
                seen.append((-1, 0))
            seen.append((k, int(words[k])))
        sizes = [n for _, n in seen]
        while True:
            # breaks, and lines taken already, match nothing
            rest = [number[lines[k]] if k in left else -2 - x for x, (k, _) in enumerate(seen)]
            took = {seen[x][0] for x in common_blocks(theirs, rest, sizes, least)}
            if not took:
                took = next((set(range(p, e)) for p, e in mine if left.issuperset(range(p, e))), set())
            if not took:
                break
            left -= took
            gone |= took
    return sorted(gone)


BLOCKS = "doc_id long, at long, block long, check long, first int, n int"


def shared_blocks(lines: DataFrame, least: int = 10) -> DataFrame:
    """(doc_id, at, e_id, e_at, p, q, n): blocks of n lines from line p of a document that stand from line q in the first document that holds them.

    `lines` (doc_id, at, hashes, words) has one row a document; (doc_id, at) is its key and its order.
    """
    bounded_batches(lines.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ats, sizes, cols = b.column(0).to_numpy(), b.column(1).to_numpy(), [], [[], [], [], []]
            flat_h, flat_w = b.column(2).flatten().to_numpy(), b.column(3).flatten().to_numpy()
            ends = np.cumsum(b.column(2).value_lengths().to_numpy())
            for lo, hi in zip(np.concatenate([[0], ends[:-1]]), ends):
                h = flat_h[lo:hi]
                first, end = shortest_blocks(flat_w[lo:hi].astype(np.int64), least)
                key, check = block_hashes(h, first, end)
                _, once = np.unique(key, return_index=True)  # the first place of each block
                sizes.append(len(once))
                for col, x in zip(cols, (key, check, first, end - first)):
                    col.append(x[once])
            parts = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols]
            if sum(sizes):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, sizes)), pa.array(np.repeat(ats, sizes)), pa.array(parts[0]), pa.array(parts[1]), pa.array(parts[2], pa.int32()), pa.array(parts[3], pa.int32())],
                    ["doc_id", "at", "block", "check", "first", "n"],
                )

    rows = materialize(lines.where(F.size("hashes") > 0).select("doc_id", "at", "hashes", "words").mapInArrow(cut, BLOCKS), "lines-blocks")
    who = F.struct("doc_id", "at", "first", "check", "n")
    held = rows.groupBy("block").agg(F.count(F.lit(1)).alias("df"), F.min(who).alias("low")).where("df > 1").select("block", "low")
    # written before the join: both of its sides are then plain shuffles, whose large partitions Spark may split
    held = materialize(held, "lines-first-holders")
    met = rows.join(held, "block").where(
        (F.col("check") == F.col("low.check")) & (F.col("n") == F.col("low.n")) & ((F.col("doc_id") != F.col("low.doc_id")) | (F.col("at") != F.col("low.at")))
    )
    return met.select("doc_id", "at", F.col("low.doc_id").alias("e_id"), F.col("low.at").alias("e_at"), F.col("first").alias("p"), F.col("low.first").alias("q"), "n")


def document_lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, at, hashes, words, spots, total): the lines with words of each document and their places among its `total` lines; repeated rows are one."""
    tidy = F.transform(F.split(F.col(text), "\n"), lambda x, i: F.struct(F.btrim(x, F.lit(BLANK)).alias("x"), i.alias("i")))
    rows = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("at"), F.filter(tidy, lambda s: s["x"] != "").alias("l"), F.size(tidy).alias("total")
    )
    rows = rows.select(
        "doc_id", "at", F.transform("l", lambda s: F.xxhash64(s["x"])).alias("hashes"), F.transform("l", lambda s: F.size(F.split(s["x"], r"[\x20\x09-\x0D]+"))).alias("words"),
        F.transform("l", lambda s: s["i"]).alias("spots"), "total",
    )
    return rows.dropDuplicates(["doc_id", "at"])


KEEP = "doc_id long, at long, keep array<struct<first:int,n:int>>, lines_dropped int, words_dropped int"


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, block_words: int = 10) -> DataFrame:
    """(doc_id, at, keep, lines_dropped, words_dropped): the runs of lines (from 1) that stay of each document that loses some; `at` is the hash of its text."""
    lines = materialize(document_lines(docs, doc_id, text), "lines-hashed")
    shared = shared_blocks(lines, block_words)
    # a document has at most two blocks a line
    each = shared.groupBy("doc_id", "at").agg(F.sort_array(F.collect_list(F.struct("e_id", "e_at", "p", "q", "n"))).alias("blocks"))
    met = lines.join(each, ["doc_id", "at"]).select("doc_id", "at", "hashes", "words", "spots", "total", "blocks")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, at, h, w, spots, total, blocks in zip(*(c.to_pylist() for c in b.columns)):
                partners: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
                for s in blocks:
                    partners.setdefault((s["e_id"], s["e_at"]), []).append((s["p"], s["q"], s["n"]))
                drop = aligned_lines(np.array(h, np.int64), np.array(w, np.int64), list(partners.values()), block_words)
                if drop:
                    rows.append((i, at, kept_runs(drop, spots, total), len(drop), sum(w[k] for k in drop)))
            ids, ats, keep, n, words = zip(*rows) if rows else [()] * 5
            kind = pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(ats, pa.int64()), pa.array(keep, kind), pa.array(n, pa.int32()), pa.array(words, pa.int32())],
                ["doc_id", "at", "keep", "lines_dropped", "words_dropped"],
            )

    return met.mapInArrow(align, KEEP)


def kept_runs(drop: list[int], spots: list[int], total: int) -> list[dict[str, int]]:
    """Runs (first, from 1; n) of the `total` lines that stay when the lines with words `drop` go, each with the empty lines below it."""
    runs, at = [], 0
    for k in drop:
        if spots[k] > at:
            runs.append({"first": at + 1, "n": spots[k] - at})
        at = spots[k + 1] if k + 1 < len(spots) else total
    return [*runs, {"first": at + 1, "n": total - at}] if at < total else runs


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how: int) -> DataFrame:
    """`docs` with `text` less its repeated blocks, and two columns: lines_dropped, words_dropped (columns of these names are replaced)."""
    rest = docs.drop("lines_dropped", "words_dropped")
    found = repeated_lines(rest, doc_id, text, **how).select(*[F.col(c).alias(f"__cv_{c}") for c in ("doc_id", "at", "keep", "lines_dropped", "words_dropped")])
    found = materialize(found, "lines-drop")
    # one plan at every size: texts are dealt by id once, and the runs, far smaller, are the side held in memory
    met = rest.join(found.hint("shuffle_hash"), (rest[doc_id] == found["__cv_doc_id"]) & (F.xxhash64(rest[text]) == found["__cv_at"]), "left")
    split = F.split(F.col(text), "\n")
    kept = F.array_join(F.flatten(F.transform("__cv_keep", lambda r: F.slice(split, r["first"], r["n"]))), "\n")
    return met.select(
        *[(F.when(F.col("__cv_keep").isNotNull(), kept).otherwise(F.col(text)).alias(text) if c == text else F.col(c)) for c in rest.columns],
        *[F.coalesce(f"__cv_{c}", F.lit(0)).alias(c) for c in ("lines_dropped", "words_dropped")],
    )
