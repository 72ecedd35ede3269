import itertools
import random

import pytest
from awkward import prose

import corpus_pipeline
from corvane.llm import jaccard, simhash


def sets(text, words=5):
    w = (text or "").lower().encode().split()
    return {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()


def brute(rows, least=0.8):
    """Row number -> smallest id of its component over all pairs."""
    own, at = [sets(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        A, B = own[a], own[b]
        if (len(A & B) / len(A | B) if A | B else 1.0) >= least:
            at[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return [low.get(find(k)) for k in range(len(rows))]


def edited():
    """Texts with few to many edited words, a large group about one text, and a passage that unlike texts share."""
    r, out = random.Random(4), []
    for k in range(40):
        w = prose(r.randint(30, 300), 9000 + k, 1).split(" ")
        out.append(" ".join(w))
        for edits in (1, 2, 4, 8):
            v = list(w)
            for e in range(edits):
                v[r.randrange(len(v))] = f"edit{e}"
            out.append(" ".join(v))
    hub = prose(200, 77, 1).split(" ")
    for k in range(80):
        v = list(hub)
        for _ in range(4):
            v[r.randrange(len(v))] = f"own{k}"
        out.append(" ".join(v))
    out += [prose(25, 600 + k, 1) + " " + prose(60, 78, 1) for k in range(30)]
    return out


@pytest.mark.parametrize("sample, block, rounds", [(jaccard.SAMPLE, jaccard.BLOCK, 2), (20, 7, 0)])
def test_components_against_all_pairs(spark, docs, monkeypatch, sample, block, rounds):
    monkeypatch.setattr(jaccard, "SAMPLE", sample)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "FEW", block - 2 if rounds == 0 else jaccard.FEW)
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(5000 - k, t) for k, t in enumerate(edited())]
    got = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = [(r.doc_id, r.component_id) for r in got]
    key = lambda x: (x[0] or -1, x[1] or -1)
    assert sorted(map(key, got)) == sorted(map(key, zip([i for i, _ in rows], brute(rows))))


def test_the_pipeline_keeps_one_of_edited_copies(spark, docs):
    w = prose(300, 5, 1).split(" ")
    rows = [(k, " ".join([*w[: 40 * k], f"other{k}", *w[40 * k + 1 :]]), "en", "s0", None) for k in range(1, 7)]
    kept = corpus_pipeline.keep_one_of_each_group(spark, spark.createDataFrame(rows, docs.schema), "").collect()
    assert [r.doc_id for r in kept] == [1]


def test_two_texts_of_one_id_are_two_documents(spark, docs):
    a, b = prose(40, 1, 1), prose(40, 2, 1)
    for rows in ([(1, a), (5, b), (5, a)], [(5, a), (5, b), (1, a)], [(5, b), (5, b), (1, a), (None, b), (None, prose(40, 3, 1))]):
        table = spark.createDataFrame([(i, t, "en", "s0", None) for i, t in rows], docs.schema)
        kept = corpus_pipeline.keep_one_of_each_group(spark, table, "").collect()
        assert {(r.doc_id, r.text) for r in kept} - {(None, prose(40, 3, 1))} == {(1, a), (5, b)} and len(kept) == len({t for _, t in rows})


def test_a_text_is_met_by_its_rarest_shingles_counted_over_all_texts(spark):
    passages = [prose(12, 300 + k, 1) for k in range(60)]
    rows = [(k, f"{prose(60, 9500 + k, 1)} own{k} {passages[k % 60]} {passages[(k + 1) % 60]}") for k in range(120)]
    rows += [(200, rows[0][1] + " end"), (201, ""), (202, " ")]
    firsts = {r.key: set(r.firsts) for r in jaccard.heads(spark.createDataFrame(rows, "key long, text string"), 0.8, 5).collect()}
    met = {(a, b) for a, b in itertools.combinations(sorted(firsts), 2) if firsts[a] & firsts[b]}
    assert len(firsts) == len(rows) and met == {(0, 200), (201, 202)}  # passages are held by four texts: none is met by them


def test_the_setting_that_drops_shuffles_is_put_back(spark, docs):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    simhash.near_copies(docs.limit(3)).count()
    assert spark.conf.get(name, None) == before


def test_awkward_tables(clashing, docs, nothing):
    assert simhash.near_copies(clashing).count() == docs.count()
    assert simhash.near_copies(nothing).collect() == []
