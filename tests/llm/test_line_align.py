import collections
import ctypes
import random
import re

import numpy as np
import xxhash
from awkward import prose
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corvane.llm import line_align as A


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in ((i, j) for i in range(len(a)) for j in range(len(b))):
        t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_patience_matches_equal_lines_in_order():
    r = random.Random(2)
    for _ in range(300):
        a, b = ([r.randint(0, 12) for _ in range(r.randint(0, 14))] for _ in range(2))
        got = A.patience(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
        assert len(got) <= lcs(a, b)
        if len(set(a)) == len(a) and len(set(b)) == len(b):  # all lines unique: the longest common run
            assert len(got) == lcs(a, b)


def test_blocks_have_a_least_size():
    assert A.common_blocks([1, 2, 3, 4], [9, 2, 3, 8, 4], [5] * 5, 10) == [1, 2]
    assert A.common_blocks([1, 2, 3, 4], [9, 2, 3, 8, 4], [5] * 5, 5) == [1, 2, 4]
    assert A.common_blocks([1], [1], [9], 10) == []


BLANK = " \t\x0b\x0c\r"
n_words = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x))


def blocks(lines, least):
    """The shortest runs of lines (with words) of at least `least` words from each line, as tuples."""
    for i in range(len(lines)):
        for j in range(i + 1, len(lines) + 1):
            if sum(map(n_words, lines[i:j])) >= least:
                yield i, tuple(lines[i:j])
                break


def check(rows, got, least=10):
    """Plain loops over all pairs: what goes stands in a block of an earlier document, and no block of an earlier one stays. No pair is left out."""
    tidy = lambda t: [x.strip(BLANK) for x in t.split("\n") if x.strip(BLANK)]
    of = lambda r: (r.doc_id, ctypes.c_int64(xxhash.xxh64_intdigest(r.text.encode(), 42)).value)
    held = collections.defaultdict(list)  # shortest block -> its documents
    everywhere = collections.defaultdict(list)  # line -> (document, place)
    docs = {of(r): tidy(r.text) for r in rows if r.doc_id is not None and r.text is not None}
    for k, lines in docs.items():
        for _, b in blocks(lines, least):
            held[b].append(k)
        for i, x in enumerate(lines):
            everywhere[x].append((k, i))
    for r, g in zip(rows, got):
        assert r.doc_id == g.doc_id
        if r.doc_id is None or r.text is None:
            assert g.text == r.text and g.lines_dropped == 0
            continue
        me, lines, kept = of(r), docs[of(r)], tidy(g.text)
        assert g.lines_dropped == len(lines) - len(kept)
        # a kept sequence that is a subsequence; take the alignment from the left
        at, places = 0, []
        for x in kept:
            at = lines.index(x, at)
            places.append(at)
            at += 1
        gone = set(range(len(lines))) - set(places)
        if len(set(lines)) == len(lines):
            for k in gone:  # soundness: a common run around the line, of enough words, in some earlier document
                runs = []
                for other, i in everywhere[lines[k]]:
                    if other < me:
                        o, lo, hi = docs[other], 0, 1
                        while k - lo - 1 >= 0 and i - lo - 1 >= 0 and lines[k - lo - 1] == o[i - lo - 1]:
                            lo += 1
                        while k + hi < len(lines) and i + hi < len(o) and lines[k + hi] == o[i + hi]:
                            hi += 1
                        runs.append(sum(map(n_words, lines[k - lo : k + hi])))
                assert max(runs, default=0) >= least
            for i, b in blocks(lines, least):  # completeness: no block that stays whole stands in an earlier document
                assert gone & set(range(i, i + len(b))) or min(held[b]) == me


def by_row(docs):
    """Rows before and after, in one order."""
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n)
    numbered = docs.sparkSession.createDataFrame([(*r, k) for k, r in enumerate(docs.collect())], StructType([*docs.schema.fields, StructField("n", LongType())]))
    return sorted(numbered.collect(), key=key), sorted(A.dedup_lines(numbered).collect(), key=key)


def test_against_plain_loops(docs, spark):
    r = random.Random(5)
    pool = [prose(12, 1000 + k, 1) for k in range(30)]
    short = [prose(4, 2000 + k, 1) for k in range(8)]
    more = []
    for k in range(60):
        lines = [r.choice(pool) if r.random() < 0.4 else r.choice(short) if r.random() < 0.6 else prose(9, k * 50 + j, 1) for j in range(8)]
        more.append((400 + k, "\n".join(dict.fromkeys(lines)), "en", "s0", None))
    rows, got = by_row(docs.unionByName(spark.createDataFrame(more, docs.schema)))
    assert len(got) == len(rows)
    check(rows, got)
    assert sum(x.lines_dropped for x in got) > 100


def lost(spark, rows):
    before, after = by_row(spark.createDataFrame(rows, "doc_id long, text string"))
    check(before, after)
    return {(r.doc_id, r.n): r.lines_dropped for r in after}, {(r.doc_id, r.n): r.text for r in after}


def test_common_short_lines_hide_no_block(spark):
    """Each line of a passage is first held by another document, and the passage stands in many."""
    lines = [f"short line number {k}" for k in range(3)]
    rows = [(k, lines[k]) for k in range(3)] + [(10 + k, "\n".join([prose(8, k, 1), *lines, prose(8, 90 + k, 1)])) for k in range(9)]
    n, _ = lost(spark, rows)
    assert [n[10 + k, 3 + k] for k in range(9)] == [0] + [3] * 8
    ten = [f"one of ten lines it is {k}" for k in range(10)]
    n, _ = lost(spark, [(k, ten[k]) for k in range(10)] + [(20 + k, "\n".join(ten)) for k in range(9)])
    assert [n[20 + k, 10 + k] for k in range(9)] == [0] + [10] * 8


def test_repeated_and_moved_blocks(spark):
    a, b = prose(12, 71, 1), prose(14, 72, 1)
    n, texts = lost(spark, [(1, f"{a}\n{b}"), (2, f"{b}\nbetween\n{a}\n{b}"), (3, f"{a}\n{a}"), (4, f"{a}\n{a}")])
    assert n == {(1, 0): 0, (2, 1): 3, (3, 2): 2, (4, 3): 2} and texts[2, 1] == "between"
    twice = "\n".join([a, b, a, b])
    n, _ = lost(spark, [(1, twice), (2, twice)])
    assert n == {(1, 0): 0, (2, 1): 4}


def test_two_texts_of_one_id(spark):
    own = "precious unique line that nothing else in the table holds at all"
    n, texts = lost(spark, [(1, prose(20, 5, 1)), (2, prose(20, 5, 1)), (2, own)])
    assert n == {(1, 0): 0, (2, 1): 1, (2, 2): 0} and texts[2, 2] == own


def test_empty_lines_go_with_the_line_above(spark):
    a = prose(12, 71, 1)
    _, texts = lost(spark, [(1, a), (2, f"\n own\t\n\n{a}\r\n \n\nmore")])
    assert texts[2, 1] == "\n own\t\n\nmore"


def test_shortest_blocks_cover_every_block():
    r = random.Random(3)
    for _ in range(200):
        w = np.array([r.randint(1, 9) for _ in range(r.randint(1, 9))])
        first, end = A.shortest_blocks(w, 10)
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                if w[i:j].sum() >= 10:
                    inside = {k for p, e in zip(first, end) if i <= p and e <= j for k in range(p, e)}
                    assert inside == set(range(i, j))


def test_a_line_of_many_documents_stays_once(spark):
    hot = "this very common passage stands in every one of all these documents here"
    docs = spark.createDataFrame([(k, f"{prose(30, 7000 + k)}\n{hot}") for k in range(60)], "doc_id long, text string")
    got = A.dedup_lines(docs).collect()
    assert sum(hot in r.text for r in got) == 1 and hot in next(r.text for r in got if r.doc_id == 0)
    assert all(r.lines_dropped == (r.doc_id > 0) for r in got)


def test_copies_and_awkward_tables(docs, clashing, nothing):
    got = {r.doc_id: r for r in A.dedup_lines(docs).collect()}
    assert got[100].text == "" and got[0].lines_dropped == 0 and got[201].text == "" and got[200].text is None and got[203].text == "x" * 30_000
    out = A.dedup_lines(clashing)
    assert out.count() == docs.count() and set(out.columns) == set(clashing.columns) and out.where(F.col("score") != "other").isEmpty()
    assert A.dedup_lines(nothing).collect() == []
