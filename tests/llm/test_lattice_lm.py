import collections
import math
import zlib

import pytest
from pyspark.sql import functions as F

from corvane.llm import lattice_lm as M
from corvane.llm.queries import PIECE_MODEL


def splits(s):
    if not s:
        yield []
    for k in range(1, len(s) + 1):
        for rest in splits(s[k:]):
            yield [s[:k], *rest]


@pytest.fixture(scope="module")
def lattice():
    return M.Lattice.load(PIECE_MODEL)


def weight(lattice, parts):
    total = 0.0
    for p in parts:
        if p in lattice.logp:
            total += lattice.logp[p]
        elif len(p) == 1:
            total += lattice.spelt(p)
        else:
            return None
    return total


@pytest.mark.parametrize("word", ["the", "tions", "ünder", "漢字x", "a\x01b", "zqxjv"])
def test_forward_is_the_sum_over_all_segmentations(lattice, word):
    ways = [w for p in splits(M.MARK + word) if (w := weight(lattice, p)) is not None]
    assert lattice.log_probability(word) == pytest.approx(math.log(sum(map(math.exp, ways))), rel=1e-9)


def test_expected_uses_are_those_of_all_segmentations(lattice):
    into = collections.defaultdict(float)
    lattice.expect("tions", 3.0, into)
    want = collections.defaultdict(float)
    ways = [(p, math.exp(w)) for p in splits(M.MARK + "tions") if (w := weight(lattice, p)) is not None]
    for p, w in ways:
        for x in p:
            want[x] += 3.0 * w / sum(y for _, y in ways)
    assert {k: round(v, 9) for k, v in into.items() if v > 1e-12} == {k: round(v, 9) for k, v in want.items() if v > 1e-12}


def test_long_words_do_not_underflow(lattice):
    assert -1e6 < lattice.log_probability("ab" * 10_000) < -1000


def test_weights_sum_to_one(lattice):
    after = lattice.reestimated({"the": 5.0, "<195>": 2.0}, 7)
    for x in (lattice, after):
        assert sum(map(math.exp, [*x.logp.values(), *x.byte_logp, x.end_logp])) == pytest.approx(1.0)


def test_against_plain_counts(docs, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_CHARS", 3000)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    rows = docs.select("doc_id", "text", held.alias("held_out"))
    got = collections.defaultdict(list)
    for r in M.score(rows, PIECE_MODEL).collect():
        got[r.doc_id].append(r)
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    data = rows.collect()
    c = collections.Counter(w for r in data if not r.held_out for w in tokens(r.text))
    n, v = sum(c.values()), len(c)
    assert sum(map(len, got.values())) == len(data)
    for r in data:
        t = tokens(r.text)
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
        assert any(x.n_tokens == len(t) and x.n_known == sum(c[w] > 0 for w in t) and x.train_tokens == n and x.base_score == pytest.approx(base) and x.score < 0 for x in got[r.doc_id])
        if r.doc_id is not None:
            assert got[r.doc_id][0].held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)


def test_many_uses_of_a_word_in_one_text(spark):
    r = M.score(spark.createDataFrame([(1, "w " * 70_000, False)], "doc_id long, text string, held_out boolean"), PIECE_MODEL, em_steps=0).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (70_001, 70_001, 70_001)


def test_nothing_to_learn_from_and_no_rows(spark, nothing):
    r = M.score(spark.createDataFrame([(1, "a b", True)], "doc_id long, text string, held_out boolean"), PIECE_MODEL).first()
    assert r.base_score == 0.0 and r.train_tokens == 0 and r.n_known == 0 and r.score < 0
    assert M.score(nothing.select("doc_id", "text", F.lit(False).alias("held_out")), PIECE_MODEL).collect() == []
