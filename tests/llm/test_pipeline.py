import collections
import re

import pytest
from awkward import prose, rows
from test_jaccard import brute as components
from test_line_align import check as check_lines
from test_toxicity import planted

import corpus_pipeline
from corvane.llm import toxicity
from corvane.llm.common import materialize


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small documents table with planted toxic texts, copies, near copies and passages, and its labels."""
    d = str(tmp_path_factory.mktemp("sf"))
    docs = [r for r in rows() if r[0] not in (3,)] + [(1000 + i, t, "en", f"s{i % 4}", len(t)) for i, t, _ in planted(240)]
    passage = prose(60, 77, 1)
    docs += [(2000 + i, prose(30, 500 + i) + "\n" + passage, "de", "s1", None) for i in range(6)]
    long = prose(900, 42, 1).split(" ")
    docs += [(3000 + i, " ".join([*long[:450], f"edit{i}", *long[450:]]), "es", "s3", None) for i in range(4)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1000 + i, y, y) for i, _, y in planted(240) if i % 3], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


@pytest.fixture(scope="module")
def stages(spark, folder):
    docs = [spark.read.parquet(f"{folder}/documents.parquet")]
    for name, f in corpus_pipeline.STAGES:
        docs.append(materialize(f(spark, docs[-1], folder), "test-" + re.sub(r"\W+", "-", name)))
    return docs


def test_columns(stages):
    for d in stages[:-1]:
        assert d.columns == stages[0].columns and dict(d.dtypes) == dict(stages[0].dtypes)


def test_toxic_documents_go_and_clean_ones_stay(stages, spark, folder):
    kept = {r.doc_id for r in stages[1].collect()}
    bad = {1000 + i for i, _, y in planted(240) if y}
    assert len(kept & bad) <= 2 and {r.doc_id for r in stages[0].collect()} - bad <= kept
    model = toxicity.fit(toxicity.labelled_rows(stages[0], spark.read.parquet(f"{folder}/labels.parquet")))
    assert kept == {r.doc_id for r in stages[0].collect() if model.score(model.evidence(r.text)) < 0.5}


def test_lines(stages):
    """Rows are told apart by id and number of lines lost, and held against all pairs of documents."""
    before, after = stages[1].collect(), stages[2].collect()
    assert len(before) == len(after)
    left = collections.defaultdict(list)
    for r in after:
        left[r.doc_id].append(r)
    paired = []
    for r in before:
        fits = [x for x in left[r.doc_id] if set((x.text or "").split("\n")) <= set((r.text or "").split("\n")) | {""}]
        x = min(fits, key=lambda x: x.text != r.text)
        left[r.doc_id].remove(x)
        paired.append((r, x))
    lines = lambda t: sum(bool(x.strip()) for x in (t or "").split("\n"))
    Row = collections.namedtuple("Row", "doc_id text lines_dropped")
    check_lines([r for r, _ in paired], [Row(x.doc_id, x.text, lines(r.text) - lines(x.text)) for r, x in paired])
    for r, x in paired:
        assert x.n_chars == (r.n_chars if x.text == r.text else len(x.text))
    passage = prose(60, 77, 1)
    assert sum(passage in (r.text or "") for r in after) == 1


def test_one_of_each_group_stays(stages):
    before, after = stages[2].collect(), stages[3].collect()
    low = components([(k, r.text) for k, r in enumerate(before)])
    held = {}
    for k, r in enumerate(before):
        held.setdefault(low[k], []).append(r)
    assert len(after) == len(held)
    kept = collections.Counter((r.doc_id, r.text) for r in after)
    for rows_ in held.values():
        ids = [r.doc_id for r in rows_ if r.doc_id is not None]
        first = [(r.doc_id, r.text) for r in rows_ if r.doc_id == (min(ids) if ids else None)]
        assert any(kept[f] for f in first)


def test_mix(stages):
    before, after = stages[3].collect(), stages[4].collect()
    size = lambda t: len((t or "").encode().split())
    own, got, text = collections.Counter(), collections.Counter(), {}
    for r in before:
        own[r.source] += size(r.text)
        text[(r.doc_id, r.source)] = r.text
    for r in after:
        got[r.source] += size(r.text)
        assert r.text in text[(r.doc_id, r.source)] and r.text
        assert r.n_chars is None or r.n_chars == len(r.text) or r.text == text[(r.doc_id, r.source)]
    assert all(got[s] <= 2 * own[s] for s in own) and abs(sum(got.values()) - 1.5 * sum(own.values())) < 60
    names = sorted(s for s in own if s is not None) + [None] * (None in own)
    free = {s: got[s] / (3, 1, 2)[k % 3] for k, s in enumerate(names) if got[s] < 2 * own[s] - 30}
    assert not free or max(free.values()) - min(free.values()) < 60


def test_encoding_is_lossless_and_run_is_the_stages(stages, spark, folder):
    coded = stages[5].collect()
    assert len(coded) == stages[4].count() and all(r.lossless and r.n_ids == len(r.ids) for r in coded)
    key = lambda r: (str(r.doc_id), str(r.source), r.ids)
    assert sorted(map(key, corpus_pipeline.run(spark, folder).collect())) == sorted(map(key, coded))


def test_stages_on_awkward_tables(docs, clashing, nothing, spark, folder):
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, nothing, folder)
        assert empty.collect() == [], name
        out = stage(spark, clashing, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == clashing.columns and empty.columns == nothing.columns, name
            assert out.where("score <> 'other' OR size <> 'other' OR spot <> 'other'").isEmpty(), name
        assert out.count() > 0, name


def test_repeated_rows_take_what_their_places_take(spark, docs):
    from corvane.llm import mixing

    same = ("w " * 50).strip()
    rows = [(1, same, "en", "a", None)] * 7 + [(None, same, "en", "b", None)] * 3 + [(2, prose(400, 3, 1), "en", "c", None)]
    table = spark.createDataFrame(rows, docs.schema)
    want = collections.Counter()
    for r in mixing.mix(table, seed=7).collect():
        want[r.doc_id, r.source] += r.taken
    got = collections.Counter()
    for r in corpus_pipeline.mix_sources(spark, table, "").collect():
        got[r.doc_id, r.source] += len(r.text.split())
    assert got == +want
