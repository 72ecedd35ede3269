"""Operators on small fixtures: what must never happen, edge cases, ties."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import chunking, dense, evaluation, fusion, graph, knowledge, ledger, lexical, packing, security, temporal
from corvane.plans import ingesting, sqltool
from corvane.plans.evaluating import routed
from corvane.sources import parsing


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, f"r{i}", "title", "gateway error code " * 5, ["restricted"], "active") for i in range(12)]
    rows += [(100 + i, f"e{i}", "other", "the gateway explained once", ["engineering"], "active") for i in range(8)]
    rows += [(200, "d1", "draft", "gateway", ["engineering"], "draft"), (201, "n1", "null roles", "gateway", None, "active"), (202, "n2", None, None, ["engineering"], "active"), (203, "u1", "x", "gateway", ["a_b"], "active")]
    return spark.createDataFrame(rows, "doc_id long, document_id string, title string, content string, allowed_roles array<string>, status string")


def ids(df, c="document_id"):
    return sorted(r[c] for r in df.collect())


def test_access_before_scores(spark, corpus):
    q = spark.createDataFrame([(1, "gateway error")], "query_id int, query string")
    for principal, allowed in ((["engineering"], "e"), (["restricted"], "r")):
        hits = lexical.max_normalised(lexical.bm25(security.authorized(corpus, principal), q)).join(corpus, "doc_id").collect()
        assert hits and all(h.document_id.startswith(allowed) for h in hits)
    assert ids(security.authorized(corpus, [])) == [] and ids(security.authorized(corpus, ["unknown"])) == []
    assert "n1" in ids(security.restricted_ids(corpus, ["engineering"])) and "d1" not in ids(security.authorized(corpus, ["engineering"]))
    assert ids(security.authorized(corpus, ["aXb"])) == [] and ids(security.authorized(corpus, ["a_b"])) == ["u1"]
    for bad in ("a' OR 1=1", "", "x" * 65, "a|b"):
        with pytest.raises(ValueError):
            security.authorized(corpus, [bad])
    assert ids(security.among(corpus, corpus.where("false"))) == []


def test_statistics_depend_on_the_principal(spark):
    docs = spark.createDataFrame([(1, "alpha beta", "a"), (2, "alpha", "a"), (3, "beta", "b")], "doc_id long, content string, role string")
    q = spark.createDataFrame([(1, "alpha beta")], "query_id int, query string")
    score = lambda d: {r.doc_id: round(r.raw, 6) for r in lexical.bm25(d, q).collect()}
    assert score(docs)[1] != score(docs.where("role = 'a'"))[1]


def test_bm25_by_hand(spark):
    import math

    docs = spark.createDataFrame([(1, "a1 a1 b1"), (2, "b1 c1")], "doc_id long, content string")
    got = {r.doc_id: r.raw for r in lexical.bm25(docs, spark.createDataFrame([(1, "a1 a1")], "query_id int, query string")).collect()}
    assert got == {1: pytest.approx(math.log(1 + 1.5 / 1.5) * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 2.5)))}


def test_zero_scores_stay_zero(spark):
    s = spark.createDataFrame([(1, 1, 0.0), (1, 2, 0.0)], "query_id int, doc_id int, raw double")
    assert [r.score for r in lexical.max_normalised(s).collect()] == [0.0, 0.0]


def test_ranks(spark):
    hits = spark.createDataFrame([(1, "a", 0.9, 0.1), (1, "b", 0.9, 0.8), (1, "c", 0.5, 0.8)], "query_id int, doc string, score double, rerank double")
    order = lambda s: [r.doc for r in fusion.reranked(hits, "doc", s).orderBy("final_rank").collect()]
    assert order("replace") == ["b", "c", "a"] and order("weighted_rrf") == ["b", "a", "c"]
    with pytest.raises(ValueError):
        fusion.reranked(hits, "doc", "other")
    assert [r.v for r in spark.range(1).select(dense.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("v")).collect()] == [0.0]


def test_two_hops_without_cycles_and_rights_first(spark):
    e = spark.createDataFrame([("a", "b", "references", 0.9, 1), ("b", "c", "references", 0.8, 2), ("c", "a", "references", 0.7, 3), ("a", "x", "references", 1.0, 4), ("x", "c", "references", 1.0, 5), ("b", "b", "references", 1.0, 6), ("a", "b", "references", 0.5, 0)], "source_id string, target_id string, relation string, confidence double, seq int")
    best = graph.strongest(e)
    assert best.where("source_id = 'a' AND target_id = 'b'").first().confidence == 0.9 and best.where("source_id = target_id").isEmpty()
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "document_id string")
    seeds = spark.createDataFrame([(1, "a", 0), (1, "x", 1)], "query_id int, node string, ord int")
    got = [(r.path, round(r.confidence, 6), r.hops) for r in graph.expand(best, nodes, seeds).orderBy("rank").collect()]
    assert got == [(["a", "b"], 0.9, 1), (["a", "b", "c"], 0.72, 2)]
    assert [r.node for r in graph.dangling(best, nodes).collect()] == ["x"]
    with pytest.raises(ValueError):
        graph.expand(best, nodes, seeds, max_hops=5)


def test_path_limit_is_in_breadth_first_order(spark):
    import random

    r = random.Random(1)
    edges = [(f"n{a}", f"n{b}", "r", r.random(), k) for k, (a, b) in enumerate((a, b) for a in range(10) for b in range(10) if a != b and r.random() < 0.4)]
    nodes, limit = [f"n{k}" for k in range(10)], 9
    queue, found = [(["n0"], 1.0), (["n3"], 1.0)], []
    while queue and len(found) < limit:
        path, c = queue.pop(0)
        if len(path) > 2:
            continue
        for s, t, _, conf, _ in edges:
            if s == path[-1] and t not in path:
                found.append((path + [t], c * conf))
                queue.append(found[-1])
    want = sorted(found[:limit], key=lambda x: (len(x[0]), -x[1]))
    e = spark.createDataFrame(edges, "source_id string, target_id string, relation string, confidence double, seq int")
    got = graph.expand(e, spark.createDataFrame([(n,) for n in nodes], "document_id string"), spark.createDataFrame([(1, "n0", 0), (1, "n3", 1)], "query_id int, node string, ord int"), 2, limit)
    assert [r.path for r in got.orderBy("rank").collect()] == [p for p, _ in want]


def test_hyperedges(spark):
    m = spark.createDataFrame([(1, "x"), (2, "x"), (2, "y"), (3, "y"), (4, "z")], "doc_id int, entity string")
    seed = spark.createDataFrame([(1,)], "doc_id int")
    assert {(r.doc_id, r.hop) for r in graph.hyperedges(m, seed, 2).collect()} == {(1, 0), (2, 1), (3, 2)}


@pytest.fixture(scope="module")
def memory(spark):
    d = lambda n: dt.datetime(2024, 1, n)
    a = spark.createDataFrame([(1, 7, d(1), d(1)), (2, 7, d(4), d(5)), (3, 7, d(20), d(2)), (4, 8, d(1), d(1))], "assertion_id int, subject_id int, valid_from timestamp, recorded_at timestamp")
    r = spark.createDataFrame([(10, 2, 1, "supersedes", d(4), d(5)), (11, 4, 1, "contradicts", d(2), d(2)), (12, 4, 2, "reinforces", d(5), d(5))], "relation_id int, source_assertion_id int, target_assertion_id int, relation_type string, effective_at timestamp, recorded_at timestamp")
    return a, r


def state(memory, valid, known):
    return {r.assertion_id: r.lifecycle for r in temporal.resolve(*memory, valid, known).collect()}


def test_history_is_kept_and_knowledge_has_a_time(memory):
    assert state(memory, "2024-01-10", "2024-01-10") == {1: "SUPERSEDED", 2: "ACTIVE", 3: "FUTURE", 4: "ACTIVE"}
    assert state(memory, "2024-01-10", "2024-01-04") == {1: "CONTESTED", 3: "FUTURE", 4: "ACTIVE"}  # the update isn't known yet
    assert state(memory, "2024-01-01", "2024-01-10") == {1: "ACTIVE", 2: "FUTURE", 3: "FUTURE", 4: "ACTIVE"}


def test_use_does_not_revive(spark, memory):
    states = temporal.resolve(*memory, "2024-01-10", "2024-01-10").withColumn("confidence", F.lit(0.5)).withColumn("importance", F.lit(0.5))
    events = spark.createDataFrame([(1, "successful", dt.datetime(2024, 1, 9))] * 20, "assertion_id int, outcome string, at timestamp")
    used = temporal.usage(states.select("assertion_id"), events)
    lex = spark.createDataFrame([(1, 1)], "assertion_id int, lex_rank int")
    assert {r.assertion_id for r in temporal.searched(states, used, lex, None, "2024-01-10").collect()} == {2, 4}
    assert {r.assertion_id for r in temporal.searched(states, used, lex, None, "2024-01-10", "historical").collect()} == {1, 2, 4}
    assert {r.assertion_id: r.uses for r in used.collect()} == {1: 20, 2: 0, 3: 0, 4: 0}
    with pytest.raises(ValueError):
        temporal.searched(states, used, lex, None, "2024-01-10", "never")


def test_violations(spark, memory):
    r = spark.createDataFrame([(1, 1, 1), (2, 1, 99), (3, 98, 1), (4, 4, 1), (5, 2, 1), (6, None, 1)], "relation_id int, source_assertion_id int, target_assertion_id int")
    assert {x.relation_id: x.issue for x in temporal.violations(r, memory[0]).collect()} == {1: "self", 2: "unknown target", 3: "unknown source", 4: "other subject"}


def test_packs_differ(spark):
    h = spark.createDataFrame([(1, 1, 60, 1), (1, 2, 60, 2), (1, 3, 30, 3), (1, 4, 20, 4)], "query_id int, doc_id int, tokens int, rank int")
    assert [(r.doc_id, r.taken) for r in packing.truncating(h, 100).orderBy("rank").collect()] == [(1, 60), (2, 40)]
    assert [r.doc_id for r in packing.skipping(h, 100, "doc_id").orderBy("place").collect()] == [1, 3]


def test_covering_skips_near_duplicates(spark):
    g = lambda x: [x[k : k + 3] for k in range(len(x) - 2)]
    h = spark.createDataFrame([(1, "a", 0.9, g("the same sentence here")), (1, "b", 0.8, g("the same sentence here")), (1, "c", 0.7, g("another one entirely"))], "query_id int, document_id string, score double, grams array<string>")
    assert [r.document_id for r in packing.covering(h, 2).orderBy("place").collect()] == ["a", "c"]


def test_measures(spark):
    ranked = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 9, 1)], "query_id int, document_id int, rank int")
    rel = spark.createDataFrame([(1, 6), (1, 7), (3, 1)], "query_id int, document_id int")
    got = {r.query_id: r for r in evaluation.ranked_measures(ranked, rel, spark.createDataFrame([(1,), (2,), (3,)], "query_id int")).collect()}
    assert (got[1].recall, got[1].reciprocal_rank) == (0.5, 0.5) and got[1].ndcg == pytest.approx(0.386853, abs=1e-6) and got[2].ndcg == got[3].recall == 0.0
    w = spark.createDataFrame([(0, 0), (10, 10), (0, 10)], "h int, n int").select(evaluation.wilson(F.col("h"), F.col("n")).alias("w")).collect()
    assert w[0].w == (0.0, 0.0) and w[1].w.high == 1.0 and w[1].w.low == pytest.approx(0.722, abs=1e-3) and w[2].w.low == 0.0


def test_ledger(spark):
    h = ledger.numbered(spark.createDataFrame([("a", "f1", 1), ("a", "f2", 2), ("b", "g", 3)], "asset_id string, fingerprint string, t int"), "asset_id", "t")
    new = spark.createDataFrame([("a", "f2"), ("b", "new"), ("c", "z")], "asset_id string, fingerprint string")
    assert {(r.asset_id, r.outcome, r.version_number) for r in ledger.published(h, new).collect()} == {("a", "unchanged", 2), ("b", "new", 2), ("c", "new", 1)}
    back = spark.createDataFrame([("a", "f1")], "asset_id string, fingerprint string")
    assert ledger.published(h, back).first().outcome == "reused"
    assert ledger.reconciled(h.select("asset_id").distinct(), h.select("asset_id").distinct(), "asset_id").isEmpty()


def test_nearest_within(spark):
    a = spark.createDataFrame([(1, 1, 100), (1, 2, 500), (2, 3, 0)], "doc_id int, left_id int, at int")
    b = spark.createDataFrame([(1, 7, 90), (1, 8, 110), (1, 9, 719), (2, 10, 221)], "doc_id int, right_id int, at int")
    assert {(r.left_id, r.right_id, r.distance) for r in knowledge.nearest_within(a, b, 220).collect()} == {(1, 7, 10), (2, 9, 219)}


def test_sql_tool(spark):
    sales = spark.createDataFrame([("SO-1001", "华东", "2026Q1", 10.0), ("SO-1002", "华南", "2026Q1", 20.5), ("SO-1003", "华东", "2026Q2", 30.0)], "order_id string, region string, period string, amount double")
    for question, want in (("total sales east", 40.0), ("average in 2026Q1", 15.25), ("how many orders south", 1), ("华东 2026年第一季度 销售额", 10.0)):
        sql, values = sqltool.plan(question)
        assert list(sqltool.run(spark, sql, {"sales": sales}, **values).first())[0] == want
    for bad in ("DELETE FROM sales", "INSERT INTO sales VALUES (1)", "SELECT 1", "SELECT * FROM other", "SELECT 1 FROM sales; SELECT 2 FROM sales", "DROP TABLE sales", "WITH x AS (SELECT 1) SELECT * FROM x", "SELECT * FROM sales WHERE amount > (SELECT max(a) FROM secret)", "SELECT * FROM sales UNION SELECT * FROM sales", "CREATE TABLE t AS SELECT * FROM sales"):
        with pytest.raises(sqltool.NotReadOnly):
            sqltool.check(spark, bad, {"sales"})
    assert sqltool.check(spark, "SELECT s.region, count(*) FROM sales s JOIN (SELECT region FROM sales GROUP BY region HAVING count(*) > 1) t ON s.region = t.region GROUP BY s.region ORDER BY 2 LIMIT 3", {"sales"}) == {"sales"}
    assert sqltool.answer([]) == "no rows" and sqltool.answer([{"n": 1}]) == "n: 1"


def test_routes(spark):
    q = spark.createDataFrame([("delete the related document",), ("related document about ABC-123",), ("count of ABC-123",), ("ABC-123",), ("why",)], "question string")
    assert [r.route for r in routed(q).collect()] == ["handoff_or_refuse", "rag", "tool", "exact_search", "rag"]


def test_chunkers():
    text = "# One\n" + "word " * 700 + "\n2. Two\n" + "x" * 100 + " end. More text here.\n\nCAPITAL LINE\nlast"
    parts = chunking.structured(text, 100, 20, 300)
    assert max(p["token_count"] for p in parts) <= 100 and {p["section_title"] for p in parts} == {"One", "2. Two", "CAPITAL LINE"} and parts == chunking.structured(text, 100, 20, 300)
    assert chunking.structured("") == [] and chunking.legacy("") == []
    assert all(len(c) <= 900 for c in chunking.legacy(("p" * 2500) + "\n\n" + "q" * 500 + "\n\nr")) and "".join(chunking.legacy("a\n\nb")) == "a\n\nb"
    covered = {k for a, b in chunking.windows(text, 50, 10) for k in range(a, b)}
    assert all(k in covered for a, b in chunking.spans(text) for k in range(a, b))
    for bad in ({"child": 10, "overlap": 10}, {"child": 2000}):
        with pytest.raises(ValueError):
            chunking.structured("x", **bad)


def test_parsing(spark):
    page = "<html><head><title>T</title><script>no()</script></head><body><nav>menu</nav><h1>Top</h1><p>One <b>two</b></p><ul><li>item</li></ul><table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table></body></html>"
    docx = io.BytesIO()
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(docx, "w") as z:
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    files = [("a.html", page.encode()), ("b.docx", docx.getvalue()), ("c.md", b"# H\n- item\ntext\n## 3.2 Deep\n### Next"), ("d.pdf", b"%PDF"), ("e.docx", b"broken"), ("f", b"?")]
    got = {r.path: r for r in parsing.parse(spark.createDataFrame([(p, bytearray(b)) for p, b in files], "path string, content binary")).collect()}
    kinds = lambda p: [(b.kind, b.text) for b in got[p].blocks]
    assert got["a.html"].title == "T" and kinds("a.html") == [("heading", "Top"), ("paragraph", "One two"), ("list_item", "item")] and got["a.html"].tables == [[["a", "b"], ["c"]]] and got["a.html"].suppressed == ["menu"]
    assert kinds("b.docx") == [("heading", "Head"), ("paragraph", "Text")] and got["b.docx"].tables == [[["x"]]]
    assert [b.section for b in got["c.md"].blocks] == ["1", "1", "1", "3.2", "3.2.1"]
    assert [got[p].failed for p in ("a.html", "d.pdf", "e.docx", "f")] == [False, True, True, True] and got["e.docx"].error
    assert parsing.table_markdown([["a", "b"], ["c"]]).splitlines()[-1] == "| c |  |" and parsing.table_markdown([["a"], ["b"]], True) == "| a | (1 rows)"


def test_jsonl_and_versions(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    good, bad = parsing.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int")
    assert sorted(r.a for r in good.collect()) == [1, 2] and [r.line for r in bad.collect()] == ["not json"]
    for v in ("1", "2"):
        parsing.write_version(spark.createDataFrame([(v,)], "x string"), str(tmp_path / "t"), v)
        parsing.point_to(spark, str(tmp_path / "t"), v)
    assert parsing.read_active(spark, str(tmp_path / "t")).first().x == "2"
    parsing.point_to(spark, str(tmp_path / "t"), "1")  # roll back
    assert parsing.read_active(spark, str(tmp_path / "t")).first().x == "1"
    with pytest.raises(Exception, match="exist"):
        parsing.write_version(spark.createDataFrame([("9",)], "x string"), str(tmp_path / "t"), "1")


def test_text_functions(spark):
    row = lambda *c: spark.range(1).select(*[x.alias(f"c{k}") for k, x in enumerate(c)]).first()
    r = row(T.retrieval_tokens(F.lit("Ab-c é 漢字 x_1")), T.budget_tokens(F.lit("a" * 40 + " b, 漢")), T.stem(F.lit("operations")), T.stem(F.lit("sing")), T.slug(F.lit(" A  b! ")), T.collapse(F.lit(" a \n b ")), T.char_grams(F.lit("a b")), T.char_grams(F.lit("abcd")))
    assert r.c0 == ["ab-c", "漢", "字", "x_1"] and r.c1 == 3 + 1 + 1 + 1 and (r.c2, r.c3) == ("operation", "sing") and r.c4 == "a-b" and r.c5 == "a b" and r.c6 == ["ab"] and r.c7 == ["abc", "bcd"]
    f = row(T.reinforcement(F.lit(0), F.lit(0), F.lit(0), F.lit(0)), T.reinforcement(F.lit(20), F.lit(20), F.lit(0), F.lit(0)))
    assert f.c0 == 0.0 and f.c1 == 1.0


def test_hash_embedding(spark):
    d = spark.createDataFrame([(1, "alpha beta alpha"), (2, "alpha beta alpha"), (3, "")], "doc_id long, text string")
    v = {r.doc_id: r.vector for r in ingesting.hashed(d, 64).collect()}
    assert v[1] == v[2] and sum(x * x for x in v[1]) == pytest.approx(1.0, abs=1e-5) and not any(v[3])


def test_evidence_and_answers(spark):
    from corvane.operators import answering as A

    hits = spark.createDataFrame([(1, "gateway error VPN-401", 5, 0, "nothing of use", 0.9), (1, "gateway error VPN-401", 5, 1, "the gateway gives VPN-401", 0.2)], "query_id long, query string, doc_id long, position int, content string, score double")
    assert A.best_evidence(hits).first().position == 1
    text = "The gateway restarts at night. Unrelated filler sentence here. Error VPN-401 means a bad password! Last words."
    units = lambda t: spark.createDataFrame([(t,)], "t string").select(A.sentence_units(F.col("t"))).first()[0]
    assert "VPN-401" in A.excerpt("what is error VPN-401", units(text), 60) and len(A.excerpt("x", units(text * 20), 100)) <= 100
    assert units("A b. A B. c\nd\n\n") == ["A b.", "A B.", "c", "d"] and A.excerpt("dd", ["A b.", "a B.", "cc", "dd"], 6) == "cc dd"
    rows = spark.createDataFrame([(1, "error VPN-401", "d1", text, 1), (1, "error VPN-401", "d2", "other", 2), (1, "error VPN-401", "d3", "x", 4)], "query_id long, query string, document_id string, content string, rank int")
    a = A.answers(rows).first()
    assert a.citations == ["d1", "d2"] and a.answer.endswith("[2]")
    r = spark.range(1).select(A.redacted(F.lit("doc-1 doc-12 a.doc-1 (doc-1)."), F.array(F.lit("doc-1"))).alias("t")).first().t
    assert r == "[restricted] doc-12 a.doc-1 ([restricted])."


def test_replay(spark):
    from corvane.operators import answering as A

    pool = spark.createDataFrame([("k1", 1), ("k2", 2)], "key string, doc int")
    met, left = A.replayed(pool, spark.createDataFrame([("k1", 0.5), ("k1", 0.5)], "key string, rerank double"))
    assert [(r.key, r.rerank) for r in met.collect()] == [("k1", 0.5)] and [r.key for r in left.collect()] == ["k2"]
    with pytest.raises(ValueError):
        A.replayed(pool, spark.createDataFrame([("k1", 0.5), ("k1", 0.6)], "key string, rerank double"))


def test_extraction(spark):
    from corvane.operators import extraction as X

    note = "Intro text\nPROBLEM\nIBM MQ 9.1.0 throws NullPointerException, see swg21999 and VPN-401.\n# Fix:\napply it"
    d = spark.createDataFrame([("swg1", note), ("swg2", ""), ("swg3", None)], "document_id string, content string")
    parts = [(r.ordinal, r.title, r.body, r.start) for r in X.sections(d).where("document_id = 'swg1'").orderBy("ordinal").collect()]
    assert [p[1] for p in parts] == ["", "PROBLEM", "Fix"] and all(note[p[3] :].startswith(("Intro", "PROBLEM", "# Fix")) for p in parts) and parts[2][2] == "apply it"
    got = X.entities(d).collect()
    assert {(r.kind, r.name) for r in got} >= {("product", "IBM MQ"), ("version", "9.1.0"), ("error", "NullPointerException"), ("document", "swg21999"), ("ticket", "VPN-401")}
    assert all(note[r.start : r.end] == r.name for r in got)
    rel = {(r.source, r.target, r.relation) for r in X.relations(X.entities(d)).collect()}
    assert ("swg1", "swg21999", "references") in rel and any(r[2] == "version_of" and r[0] == "9.1.0" for r in rel)
    units = X.review_units(spark.createDataFrame([("a", 0, "x" * 50), ("a", 1, "y" * 30), ("a", 2, "z" * 250)], "document_id string, ordinal int, body string"), most=100, overlap=10).orderBy("unit").collect()
    assert [len(u.text) for u in units][0] == 81 and all(len(u.text) <= 100 for u in units)


def test_zip_members(spark):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("a/x.txt", "one")
        z.writestr("y.txt", "two")
    got = parsing.unzipped(spark.createDataFrame([("z.zip", bytearray(data.getvalue()))], "path string, content binary")).collect()
    assert {(r.path, bytes(r.content)) for r in got} == {("a/x.txt", b"one"), ("y.txt", b"two")}


def test_titles_within_words_of_a_question(spark, tmp_path):
    titles = ["beginning of things", "gin", "g of t", "beginning of", "things", "ö", "what does", "nothing", "", "begin  again"]
    rows = [(0, "Beginning of things\nbody"), *[(k, f"{t}\nbody") for k, t in enumerate(titles, 1)], (50, "Schön  und\tgut")]
    docs = [(i, t, "en", "s") for i, t in rows if i % 7]  # every seventh is restricted, but still readable by its language
    spark.createDataFrame(docs + [(i, t, "en", "s") for i, t in rows if i % 7 == 0], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(99, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    clean = {i: " ".join(t.split("\n")[0].split()).lower() for i, t in rows}
    want = {(q, f"doc-{d}") for q in (0, 50) for d, t in clean.items() if t and t in f"what does {clean[q]} say"}
    from corvane.plans import retrieval

    got = retrieval.title_in_query(spark, str(tmp_path)).collect()
    assert {(r.query_id, r.document_id) for r in got} == want and len(got) == len(want) and (0, "doc-2") in want and (50, "doc-6") in want


def test_best_by_bm25_are_those_of_all(spark):
    import random

    r = random.Random(5)
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(r.choices(words, k=r.randrange(0, 60))) for _ in range(300)] + ["w1 w2 w3"] * 30 + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string").repartition(5)
    asked = spark.createDataFrame([(k, " ".join(r.choices(words, k=1 + k % 9))) for k in range(30)] + [(30, "none of these"), (31, "w1 w2 w3")], "query_id long, query string")
    place = lambda raw: {(x.query_id, x.doc_id, x.rank): x.score for x in lexical.top(lexical.max_normalised(raw).withColumn("score", F.round("score", 6)), 7, "score", "doc_id").collect()}
    few = lexical.bm25_best(docs, asked, 7)
    got, want = place(few), place(lexical.bm25(docs, asked))
    assert got == want and len(want) > 200
    assert few.count() < lexical.bm25(docs, asked).count() / 2  # the rest leaves no task
    whole = {(x.query_id, x.doc_id): x.raw for x in lexical.bm25(docs, asked).collect()}
    assert all(x.raw == pytest.approx(whole[x.query_id, x.doc_id]) for x in few.collect())


def test_a_batch_of_too_many_terms_goes_by_joins(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a1 b1"), (2, "b1 c1")], "doc_id long, content string")
    asked = spark.createDataFrame([(1, "a1 b1 c1")], "query_id long, query string")
    want = sorted(map(tuple, lexical.bm25_best(docs, asked, 5).collect()))
    monkeypatch.setattr(lexical, "MOST_TERMS", 2)
    assert [x[:2] for x in sorted(map(tuple, lexical.bm25_best(docs, asked, 5).collect()))] == [x[:2] for x in want] and len(want) == 2


def test_features_where_patterns_are_passed_over(spark):
    import re

    texts = ["", "  \n\t\n\x1c First  line \r\nIBM MQ 2035 and v1.2, swg2 Datapower", "mq 9", "swgx only", "MQRC_NOT_OK", "no such thing", "IOError then FooException 1.2", "ABC-12 ABC123X", " x\x85y", "WAS was Was", "  \n second"]
    d = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", T.headline(F.col("t")).alias("h"), T.identifiers(F.col("t")).alias("ids"), T.versions(F.col("t")).alias("v"), T.named(F.col("t"), T.PRODUCTS).alias("p"))
    plain = lambda t, ps: {m[0].lower() for p in ps for m in re.finditer(p, t, re.ASCII)}
    for r in d.collect():
        t = texts[r.i]
        lines = [x for x in (re.sub(r"[ \t\n\x0b\f\r]+", " ", line).strip(" ") for line in re.split(T.LINE_END, t)) if x]
        assert r.h == (lines[0][:360] if lines else None), t
        assert set(r.ids) == plain(t, T.IDENTIFIERS) | {f"mq {m[2]}" for m in re.finditer(T.NUMBERED_NAME, t, re.ASCII)} and set(r.v) == plain(t, [T.VERSION])
        assert set(r.p) == {n for n, ps in T.PRODUCTS.items() if any(re.search(p, t, re.ASCII) for p in ps)}
