"""Recall branches, pools, exact search, guards and parents; features and tokens of questions; versions of graphs and indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import ledger, lexical, recall
from corvane.plans.registry import AUTH, DOCS, TOKEN, query
from corvane.plans.retrieval import BM25, PRINCIPAL, authorized, bm25_scored
from corvane.sources import model


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_features(t: str) -> dict[str, str]:
    """The four families of explicit features in DuckDB."""
    every = lambda p, n=0: f"list_transform(regexp_extract_all({t}, {_quoted(p)}, {n}), lambda x: lower(x))"
    named = lambda names: "list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f'regexp_matches({t}, {_quoted(p)})' for p in ps)} THEN {_quoted(n)} END" for n, ps in sorted(names.items())) + "], lambda x: x IS NOT NULL)"
    # a separator may end one version and begin the next, so each stands twice
    doubled = rf"regexp_replace({t}, '([^A-Za-z0-9.])', '\1\1', 'g')"
    ver = rf"list_sort(list_distinct(list_transform(regexp_extract_all({doubled}, '(?i)(?:^|[^A-Za-z0-9])(v?\d+\.\d+(?:\.\d+)*)(?:$|[^A-Za-z0-9])', 1), lambda x: lower(x))))"
    ids = "list_sort(list_distinct(list_concat(" + ", ".join(every(p) for p in T.IDENTIFIERS) + f", list_transform({every(T.NUMBERED_NAME, 2)}, lambda n: 'mq ' || n))))"
    return {"products": named(T.PRODUCTS), "components": named(T.COMPONENTS), "identifiers": f"list_filter({ids}, lambda x: NOT list_contains({ver}, x))", "versions": ver}


def _sql_feature_text(t: str, doc: str | None = None) -> str:
    token = lambda one, x: f"'{one}_' || regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
    parts = [f"list_transform({v}, lambda f: {token(k[:-1], 'f')})" for k, v in _sql_features(t).items()] + ([f"[{token('document', doc)}]"] if doc else [])
    return f"array_to_string(list_filter(list_concat({', '.join(parts)}), lambda z: NOT regexp_matches(z, '^[a-z]+_$')), ' ')"


def _sql_focused(t: str) -> str:
    f = _sql_features(t)
    lines = rf"list_filter(list_transform(string_split_regex({t}, '\r\n|[\n\r\x0b\x0c]'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '')"
    head = f"substr(({lines})[1], 1, 360)"
    rest = f"list_filter(list_concat({', '.join(f.values())}), lambda z: NOT contains(lower({head}), lower(z)))"
    return f"CASE WHEN len({lines}) = 0 THEN trim({t}) ELSE trim(array_to_string(list_concat([{head}], {rest}), ' ')) END"


_SAME = r"focused = '' OR lower(trim(regexp_replace(focused, '\s+', ' ', 'g'))) = lower(trim(regexp_replace(text, '\s+', ' ', 'g')))"


@query(f"""WITH f AS (SELECT doc_id, coalesce(text, '') AS text, {_sql_focused("coalesce(text, '')")} AS focused FROM documents)
  SELECT doc_id, focused, CASE WHEN {_SAME} THEN 1 ELSE 2 END::BIGINT AS n_queries FROM f""")
def focused_query(spark, sf_dir):
    """Each document taken as a question: its focused form, and how many questions are asked."""
    # a column for each part: an expression inside a function of array elements would be worked out again for each of them
    t = model.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    parts = t.select("doc_id", "t", T.headline(F.col("t")).alias("head"), T.identifiers(F.col("t")).alias("ids"), T.versions(F.col("t")).alias("ver"), F.concat(T.named(F.col("t"), T.PRODUCTS), T.named(F.col("t"), T.COMPONENTS)).alias("names"))
    asked = parts.select("doc_id", "t", T.focused_by(F.col("t"), F.col("head"), F.concat("names", F.array_except("ids", "ver"), "ver")).alias("focused"))
    return asked.select("doc_id", "focused", F.when(T.same_question(F.col("t"), F.col("focused")), 1).otherwise(2).cast("long").alias("n_queries"))


@query(f"SELECT doc_id, {_sql_feature_text('text', "'doc-' || doc_id")} AS features FROM documents")
def feature_tokens(spark, sf_dir):
    return model.table(spark, sf_dir, "documents").select("doc_id", T.feature_text(F.col("text"), F.concat(F.lit("doc-"), F.col("doc_id"))).alias("features"))


_STOP = ", ".join(_quoted(w) for w in T.EVALUATION_STOPWORDS)
_EVAL = lambda t: f"list_distinct(list_concat(list_filter(regexp_extract_all(lower({t}), '[a-z0-9]+'), lambda w: w NOT IN ({_STOP})), regexp_extract_all(lower({t}), '[\\x{{4e00}}-\\x{{9fff}}]')))"


@query(f"SELECT doc_id, len({_EVAL('text')})::BIGINT AS tokens, coalesce(list_sort({_EVAL('text')})[1], '') AS first_token FROM documents")
def evaluation_tokens(spark, sf_dir):
    e = T.evaluation_tokens(F.col("text"))
    return model.table(spark, sf_dir, "documents").select("doc_id", F.size(e).cast("long").alias("tokens"), F.coalesce(F.array_min(e), F.lit("")).alias("first_token"))


@query(f"""WITH {BM25}, best AS (SELECT query_id, doc_id FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) = 1),
  t AS (SELECT query_id, b.doc_id, {_EVAL('q.text')} AS g, {_EVAL('d.text')} AS c FROM best b JOIN documents d ON d.doc_id = b.doc_id JOIN benchmark q ON q.item_id = b.query_id)
  SELECT query_id, doc_id, CASE WHEN len(g) = 0 THEN 0.0 ELSE round(len(list_intersect(g, c))::DOUBLE / len(g), 6) END AS recall FROM t""")
def content_recall(spark, sf_dir):
    """How much of each question's passage the best document holds."""
    best = lexical.top(bm25_scored(spark, sf_dir, 1), 1, "score", "doc_id").select("query_id", "doc_id")
    met = best.join(model.gold(spark, sf_dir), "query_id").join(model.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return met.select("query_id", "doc_id", F.round(T.content_recall(F.col("query"), F.col("text")), 6).alias("recall"))


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[A-Za-z0-9_]+|[\x{4e00}-\x{9fff}]') AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS i FROM t),
  f AS (SELECT doc_id, term, min(i) AS i FROM u GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM f QUALIFY n <= 12)
  SELECT d.doc_id, string_agg('"' || term || '"', ' OR ' ORDER BY n) AS terms FROM documents d LEFT JOIN n USING (doc_id) GROUP BY d.doc_id""")
def search_terms(spark, sf_dir):
    """Full-text questions of the first twelve distinct terms."""
    return model.table(spark, sf_dir, "documents").select("doc_id", T.search_terms(F.col("text")).alias("terms"))


@query(rf"WITH {DOCS} SELECT document_id, lower(trim(regexp_replace(nfc_normalize(title), '\s+', ' ', 'g'))) AS name FROM docs")
def entity_names(spark, sf_dir):
    """Titles as names for comparison (these have no characters that composing for compatibility would change beyond composing)."""
    return model.documents(spark, sf_dir).select("document_id", T.entity_name(F.col("title")).alias("name"))


_ALIASES = [(p, a) for p, aliases in T.PRODUCT_ALIASES.items() for a in aliases]
_CANON = "CASE " + " ".join(f"WHEN k IN ({', '.join(_quoted(a.lower()) for a in aliases)}) THEN {_quoted(p)}" for p, aliases in T.PRODUCT_ALIASES.items()) + " ELSE n END"


@query(rf"""WITH a(i, a) AS (VALUES {', '.join(f"({i}, {_quoted(a)})" for i, (_, a) in enumerate(_ALIASES))}), m AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN upper(a) WHEN 1 THEN '  ' || replace(a, ' ', '   ') ELSE source || ' ' || a END AS said
  FROM documents JOIN a ON i = doc_id % {len(_ALIASES)}), n AS (SELECT doc_id, trim(regexp_replace(said, '\s+', ' ', 'g')) AS n, lower(trim(regexp_replace(said, '\s+', ' ', 'g'))) AS k FROM m) SELECT doc_id, {_CANON} AS product FROM n""")
def canonical_products(spark, sf_dir):
    """Product names as documents might write them: in capitals, with more blanks, or as part of other names."""
    names = model.literal_rows(spark, "i long, a string", [(i, a) for i, (_, a) in enumerate(_ALIASES)])
    said = F.when(F.col("doc_id") % 3 == 0, F.upper("a")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("  "), F.replace("a", F.lit(" "), F.lit("   ")))).otherwise(F.concat_ws(" ", "source", "a"))
    return model.table(spark, sf_dir, "documents").join(names, F.col("doc_id") % len(_ALIASES) == F.col("i")).select("doc_id", T.canonical_product(said).alias("product"))


@query(r"""WITH p AS (SELECT doc_id, text, strpos(text, 'icense') - 1 AS s FROM documents WHERE strpos(text, 'icense') > 0), q AS (SELECT *, s + 6 AS e, reverse(substr(text, 1, s)) AS b, substr(text, s + 7) AS a FROM p),
  r AS (SELECT *, s - least(CASE WHEN strpos(b, '.') > 0 THEN strpos(b, '.') ELSE s END, CASE WHEN strpos(b, chr(10)) > 0 THEN strpos(b, chr(10)) ELSE s END) AS l,
   coalesce(least(CASE WHEN strpos(a, '.') > 0 THEN e + strpos(a, '.') END, CASE WHEN strpos(a, chr(10)) > 0 THEN e + strpos(a, chr(10)) END), least(length(text), e + 240) + 1) AS r FROM q)
  SELECT doc_id, substr(trim(regexp_replace(substr(text, l + 1, r - l), '\s+', ' ', 'g')), 1, 500) AS sentence FROM r""")
def sentence_spans(spark, sf_dir):
    """The sentence about the first mention of a license."""
    d = model.table(spark, sf_dir, "documents").select("doc_id", "text", (F.instr("text", "icense") - 1).alias("s")).where("s >= 0")
    return d.select("doc_id", T.sentence_around(F.col("text"), F.col("s"), F.col("s") + 6).alias("sentence"))


def _bm25_cte(name: str, texts: str, questions: str) -> str:
    """CTEs that end in {name}(query_id, doc_id, rank): the best 20 of `texts` (doc_id, t) for `questions` (query_id, q)."""
    n = name
    return f"""{n}_x AS ({texts}), {n}_t AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(q), '{TOKEN}')) AS term FROM ({questions})),
 {n}_k AS (SELECT doc_id, unnest(regexp_extract_all(lower(t), '{TOKEN}')) AS term FROM {n}_x), {n}_l AS (SELECT doc_id, len(regexp_extract_all(lower(t), '{TOKEN}')) AS len FROM {n}_x),
 {n}_p AS (SELECT doc_id, term, count(*) AS tf FROM {n}_k WHERE term IN (SELECT term FROM {n}_t) GROUP BY ALL), {n}_d AS (SELECT term, count(*) AS df FROM {n}_p GROUP BY term), {n}_c AS (SELECT count(*) AS n, avg(len) AS avgdl FROM {n}_l),
 {n}_r AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / greatest(avgdl, 1.0)))), 6) AS raw FROM {n}_p JOIN {n}_d USING (term) JOIN {n}_l USING (doc_id) JOIN {n}_t USING (term) CROSS JOIN {n}_c GROUP BY ALL),
 {n} AS (SELECT query_id, '{n}' AS branch, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, doc_id) AS rank FROM {n}_r QUALIFY rank <= 20)"""


_QUESTIONS = f"""qs AS (SELECT item_id AS query_id, text AS query, {_sql_focused('text')} AS focused, {_sql_feature_text('text')} AS f FROM (SELECT item_id, text || chr(10) || 'License version ' || (item_id % 5) || '.0' AS text FROM benchmark))"""
_BRANCHES = f"""WITH {AUTH}, {_QUESTIONS}, {_bm25_cte('sparse', 'SELECT doc_id, content AS t FROM auth', 'SELECT query_id, query AS q FROM qs')},
 {_bm25_cte('focused', 'SELECT doc_id, content AS t FROM auth', 'SELECT query_id, focused AS q FROM qs WHERE NOT (' + _SAME.replace('text', 'query') + ')')},
 {_bm25_cte('title', 'SELECT doc_id, title AS t FROM auth', 'SELECT query_id, CASE WHEN ' + _SAME.replace('text', 'query') + ' THEN query ELSE focused END AS q FROM qs')},
 {_bm25_cte('feature', 'SELECT doc_id, ' + _sql_feature_text("title || ' ' || content") + ' AS t FROM auth', "SELECT query_id, f AS q FROM qs WHERE f <> ''")},
 br AS (SELECT * FROM sparse UNION ALL SELECT * FROM focused UNION ALL SELECT * FROM title UNION ALL SELECT * FROM feature)"""


def _asked(spark, sf_dir):
    """Each benchmark passage as a question that also names a license version."""
    return model.gold(spark, sf_dir).withColumn("query", F.concat("query", F.lit("\nLicense version "), (F.col("query_id") % 5).cast("string"), F.lit(".0")))


def _branches(spark, sf_dir):
    docs = authorized(spark, sf_dir).select("doc_id", "title", "content")
    # ten documents, and no reranker: a pool of 20 a branch
    return recall.branches(docs, _asked(spark, sf_dir), recall.pool_size(10, 2)), docs


@query(_BRANCHES + " SELECT query_id, branch, doc_id, rank FROM br")
def recall_branches(spark, sf_dir):
    return _branches(spark, sf_dir)[0]


_POOL = lambda docs: f""", facts AS (SELECT query_id, count(*) AS n, avg(len) AS avgdl FROM pool JOIN len USING (doc_id) GROUP BY query_id), met AS (SELECT p.query_id, p.doc_id, k.term, k.tf FROM pool p JOIN qt USING (query_id) JOIN tok k ON k.doc_id = p.doc_id AND k.term = qt.term),
 df AS (SELECT query_id, term, count(*) AS df FROM met GROUP BY ALL), raw0 AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / greatest(avgdl, 1.0)))) AS raw FROM met JOIN df USING (query_id, term) JOIN facts USING (query_id) JOIN len USING (doc_id) GROUP BY ALL),
 lx AS (SELECT p.query_id, p.doc_id, coalesce(raw, 0) AS raw FROM pool p LEFT JOIN raw0 USING (query_id, doc_id)), lex AS (SELECT query_id, doc_id, CASE WHEN max(raw) OVER (PARTITION BY query_id) > 0 THEN raw / max(raw) OVER (PARTITION BY query_id) ELSE 0 END AS lexical FROM lx)"""  # noqa: E731
_TOKENS = f"len AS (SELECT doc_id, len(regexp_extract_all(lower(content), '{TOKEN}')) AS len FROM auth), tok AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(content), '{TOKEN}')) AS term FROM auth) GROUP BY ALL), qt AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '{TOKEN}')) AS term FROM qs)"
_COVER = lambda k, w: f"{w} * CASE WHEN len(q.{k}) > 0 THEN len(list_intersect(q.{k}, d.{k}))::DOUBLE / len(q.{k}) ELSE 0 END"
_WEIGHTS = (("products", 0.08), ("components", 0.05), ("identifiers", 0.12), ("versions", 0.04))


@query(_BRANCHES + f""", {_TOKENS}, pool AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS r FROM br GROUP BY ALL){_POOL('auth')}, rc AS (SELECT query_id, doc_id, r / max(r) OVER (PARTITION BY query_id) AS recall FROM pool),
 qf AS (SELECT query_id, {', '.join(f'{v} AS {k}' for k, v in _sql_features('query').items())} FROM qs), df_ AS (SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in _sql_features("(title || ' ' || content)").items())} FROM auth WHERE doc_id IN (SELECT doc_id FROM pool))
 SELECT query_id, doc_id, round(lexical, 6) AS lexical, round(recall, 6) AS recall, round(0.5 * lexical + 0.5 * recall + least(0.2, {' + '.join(_COVER(k, w) for k, w in _WEIGHTS)}), 6) AS score FROM lex JOIN rc USING (query_id, doc_id) JOIN qf q USING (query_id) JOIN df_ d USING (doc_id)""")
def pool_rescore(spark, sf_dir):
    ranked, docs = _branches(spark, sf_dir)
    return recall.rescored(ranked, docs, _asked(spark, sf_dir))


_EXACT = "qs(query_id, query) AS (VALUES (1, 'which work has the Apache License version 2.0'), (2, 'attribution under CC BY 4.0'), (3, 'show document number DOC-12 or DOC-40'), (4, 'all rights reserved'))"


@query(f"""WITH {AUTH}, {_EXACT}, {_TOKENS}, ids AS (SELECT query_id, unnest(list_distinct(list_concat({', '.join(_sql_features('query')[k] for k in ('identifiers', 'versions'))}))) AS ident, regexp_matches(query, '(?i)\\bdocument\\s+(?:id|number)\\b') AS named FROM qs),
 pool AS (SELECT DISTINCT query_id, doc_id FROM ids JOIN auth ON CASE WHEN named THEN lower(document_id) = ident ELSE contains(lower(document_id || ' ' || title || ' ' || content), ident) END UNION ALL
  SELECT DISTINCT query_id, doc_id FROM qt JOIN tok USING (term) WHERE query_id NOT IN (SELECT query_id FROM ids)), whole AS (SELECT count(*) AS wn, avg(len) AS wavg FROM len){_POOL('auth').replace('SELECT query_id, count(*) AS n, avg(len) AS avgdl FROM pool JOIN len USING (doc_id) GROUP BY query_id', 'SELECT query_id, CASE WHEN query_id IN (SELECT query_id FROM ids) THEN count(*) ELSE max(wn) END AS n, CASE WHEN query_id IN (SELECT query_id FROM ids) THEN avg(len) ELSE max(wavg) END AS avgdl FROM pool JOIN len USING (doc_id), whole GROUP BY query_id')}
 SELECT query_id, doc_id, round(lexical, 6) AS score FROM lex""")
def exact_search(spark, sf_dir):
    """Questions with versions, with document numbers, and without identifiers."""
    asked = model.literal_rows(spark, "query_id int, query string", [(1, "which work has the Apache License version 2.0"), (2, "attribution under CC BY 4.0"), (3, "show document number DOC-12 or DOC-40"), (4, "all rights reserved")])
    return recall.exact(authorized(spark, sf_dir).select("doc_id", "document_id", "title", "content"), asked)


_ALL = BM25.replace("FROM auth)", "FROM docs)")


@query(f"""WITH {_ALL}, top AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= 10)
  SELECT query_id, doc_id, rank, NOT (doc_id IN (SELECT doc_id FROM auth WHERE doc_id % 5 < 4)) AS refused FROM top""")
def guarded_hits(spark, sf_dir):
    """A search that forgot the rights, looked at again: whose documents the principal may not read, or that are not among the candidates, are refused."""
    docs = model.documents(spark, sf_dir)
    found = lexical.top(lexical.max_normalised(lexical.bm25_best(docs.select("doc_id", "content"), model.gold(spark, sf_dir), 10)).withColumn("score", F.round("score", 6)), 10, "score", "doc_id").select("query_id", "doc_id", "rank")
    return recall.guarded(found, docs, PRINCIPAL, allowed=docs.where("doc_id % 5 < 4").select("doc_id"))


@query(f"""WITH {BM25}, top AS (SELECT query_id, doc_id FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 5)
  SELECT query_id, d.doc_id AS chunk_id, source AS parent_id, CASE WHEN d.doc_id % 4 = 0 THEN 'own' ELSE n || ' documents' END AS parent_content FROM top JOIN documents d USING (doc_id) LEFT JOIN (SELECT source, count(*) AS n FROM documents GROUP BY source) USING (source)""")
def parent_hydration(spark, sf_dir):
    """The best chunks of each question with their parents' texts, read after the search (a source stands for a parent)."""
    d = model.table(spark, sf_dir, "documents")
    parents = d.groupBy(F.col("source").alias("parent_id")).agg(F.concat(F.count(F.lit(1)), F.lit(" documents")).alias("parent_content"))
    chunks = d.select(F.col("doc_id"), F.col("source").alias("parent_id"), F.when(F.col("doc_id") % 4 == 0, "own").alias("parent_content"))
    hits = lexical.top(bm25_scored(spark, sf_dir, 5), 5, "score", "doc_id").select("query_id", "doc_id").join(chunks, "doc_id").withColumnRenamed("doc_id", "chunk_id")
    return recall.hydrated(hits, parents)


@query(f"""WITH {DOCS}, ln AS (SELECT doc_id, len(regexp_extract_all(lower(line), '{TOKEN}')) AS t FROM (SELECT doc_id, unnest(string_split(content, chr(10))) AS line FROM docs)), b AS (SELECT doc_id, count(*) AS n, max(t) AS m FROM ln GROUP BY doc_id)
  SELECT sum(n)::BIGINT AS chunks, count(*) AS parents, max(m) AS most_tokens, max(n) AS most_chunks FROM b""")
def chunk_maxima(spark, sf_dir):
    lines = model.lines(model.documents(spark, sf_dir)).select(F.col("doc_id").alias("parent_id"), F.size(T.retrieval_tokens(F.col("content"))).alias("token_count"))
    return recall.chunk_maxima(lines)


@query(f"""WITH {BM25}, r AS (SELECT query_id, doc_id % 7 AS doc, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= 40),
 s AS (SELECT query_id, rank, count(DISTINCT doc) OVER (PARTITION BY query_id ORDER BY rank) AS docs FROM r), st AS (SELECT query_id, rank, docs, greatest(ceil(log2(rank / 5.0::DOUBLE)), 0) AS step FROM s),
 l AS (SELECT query_id, (5 * pow(2, coalesce(min(step) FILTER (docs >= 4), max(step))))::BIGINT AS lim FROM st GROUP BY query_id)
 SELECT query_id, lim AS "limit", max(docs) AS documents FROM st JOIN l USING (query_id) WHERE rank <= lim GROUP BY ALL""")
def adaptive_recall(spark, sf_dir):
    """How far recall must double, from five chunks, for four distinct parents (ids modulo 7 stand for parents)."""
    hits = lexical.top(bm25_scored(spark, sf_dir, 40), 40, "score", "doc_id").select("query_id", (F.col("doc_id") % 7).alias("doc_id"), "rank")
    return recall.distinct_within(hits, 5, 4)


_EDGES = "e AS (SELECT 'c' || o_custkey AS source_id, 'o' || (o_orderkey % 997) AS target_id, o_orderpriority AS relation, round((o_orderkey % 90 + 10) / 100.0, 2)::DOUBLE AS confidence, o_orderkey % 3 AS wave FROM orders)"


def _edges(spark, sf_dir):
    o = model.table(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("c"), "o_custkey").alias("source_id"), F.concat(F.lit("o"), F.col("o_orderkey") % 997).alias("target_id"), F.col("o_orderpriority").alias("relation"),
                    F.round((F.col("o_orderkey") % 90 + 10) / 100.0, 2).alias("confidence"), (F.col("o_orderkey") % 3).alias("wave"))


@query(f"WITH {_EDGES} SELECT 'v2' AS version, source_id, target_id, relation, max(confidence) AS confidence FROM e WHERE wave < 2 GROUP BY ALL")
def publish_graph(spark, sf_dir):
    """A new version of a graph: unique, checked against the documents, the strongest of equal edges."""
    e = _edges(spark, sf_dir).where("wave < 2").drop("wave")
    known = _edges(spark, sf_dir).select(F.explode(F.array("source_id", "target_id")).alias("document_id")).distinct()
    return ledger.snapshot(e, known, "v2", model.literal_rows(spark, "version string", [("v1",)]))


@query(f"WITH {_EDGES} SELECT source_id, target_id, relation, max(confidence) AS confidence FROM e WHERE wave < 2 GROUP BY ALL")
def relation_merge(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return ledger.relations_for(e.where("wave = 0").drop("wave"), e.where("wave = 1").drop("wave"), replace=False)


@query("""WITH l AS (SELECT event_id, event_type <> 'error' AND event_id % 7 <> 0 AS ok FROM events) SELECT 'index-' || event_id AS index_version, 'graph-' || event_id AS graph_version FROM l WHERE ok ORDER BY event_id DESC LIMIT 1""")
def version_pointer(spark, sf_dir):
    """The pair of versions in force after a log of publishes and rollbacks, some of which failed."""
    log = model.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.lit("publish").alias("action"), F.concat(F.lit("index-"), "event_id").alias("index_version"), F.concat(F.lit("graph-"), "event_id").alias("graph_version"),
                                                     ((F.col("event_type") != "error") & (F.col("event_id") % 7 != 0)).alias("ok"))
    return ledger.pointed(log)


@query("""WITH a AS (SELECT 'p' || p_partkey AS field, p_brand AS value FROM part WHERE p_partkey % 11 <> 0), w AS (SELECT 'p' || p_partkey AS field, CASE WHEN p_partkey % 5 = 0 THEN p_type ELSE p_brand END AS value FROM part WHERE p_partkey % 13 <> 0)
  SELECT field, a.value AS active, w.value AS wanted FROM a FULL JOIN w USING (field) WHERE a.value IS DISTINCT FROM w.value""")
def contract_mismatch(spark, sf_dir):
    """Fields of two contracts that differ (parts stand for fields)."""
    p = model.table(spark, sf_dir, "part").withColumn("field", F.concat(F.lit("p"), "p_partkey"))
    active = p.where("p_partkey % 11 <> 0").select("field", F.col("p_brand").alias("value"))
    return ledger.contract_differences(active, p.where("p_partkey % 13 <> 0").select("field", F.when(F.col("p_partkey") % 5 == 0, F.col("p_type")).otherwise(F.col("p_brand")).alias("value")))


@query("""SELECT doc_id, source AS mark, 'v2' AS version FROM documents WHERE doc_id % 3 <> 1 UNION ALL SELECT doc_id, upper(source) AS mark, 'v2' AS version FROM documents WHERE doc_id % 3 = 1""")
def inherited_version(spark, sf_dir):
    """A new version that keeps what the last one has of other documents."""
    d = model.table(spark, sf_dir, "documents")
    before = d.where("doc_id % 6 <> 4").select("doc_id", F.col("source").alias("mark"), F.lit("v1").alias("version"))
    return ledger.inherited(before, d.where("doc_id % 3 = 1").select("doc_id", F.upper("source").alias("mark"), F.lit("draft").alias("version")), "doc_id", "v2")


@query("SELECT doc_id FROM documents WHERE NOT coalesce(doc_id % 2 = 0 AND doc_id % 3 > 0 AND (doc_id % 4 = 0), false)")
def resumed_build(spark, sf_dir):
    """What an interrupted build has left: documents not built, built in part, or built under another contract."""
    d = model.table(spark, sf_dir, "documents")
    built = d.where("doc_id % 2 = 0").select("doc_id", F.when(F.col("doc_id") % 3 > 0, "now").otherwise("old").alias("contract"), F.lit(4).alias("parts"), F.when(F.col("doc_id") % 4 == 0, 4).otherwise(3).alias("done"))
    return ledger.remaining(d.select("doc_id"), built, "doc_id", "now")


@query("SELECT 'doc-' || doc_id AS document_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS content_hash, min('doc-' || doc_id) OVER (PARTITION BY trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS canonical FROM documents")
def canonical_paths(spark, sf_dir):
    """Each document and the first of its copies, a row each."""
    return ledger.canonical_paths(model.documents(spark, sf_dir), "content", "document_id")
