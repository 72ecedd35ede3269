"""Evidence, answers and rule-based extraction over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import answering, extraction, lexical
from corvane.plans.registry import TOKEN, query
from corvane.plans.retrieval import LINES, authorized, bm25_scored, line_hits
from corvane.sources import model

STOP = ", ".join(f"'{w}'" for w in T.QUERY_STOPWORDS)


@query(LINES + f""", k AS (SELECT h.*, line, CASE WHEN len(list_filter(qt, lambda t: length(t) > 2 AND NOT list_contains([{STOP}], t))) > 0 THEN list_filter(qt, lambda t: length(t) > 2 AND NOT list_contains([{STOP}], t)) ELSE qt END AS mt
   FROM hits h JOIN q USING (query_id) JOIN ln USING (doc_id, position)), c AS (SELECT query_id, doc_id, position, round(len(list_intersect(mt, regexp_extract_all(lower(line), '[a-z0-9_-]+|[\\x{{4e00}}-\\x{{9fff}}]')))::DOUBLE / len(mt), 9) AS cov, score FROM k)
   SELECT query_id, doc_id, position, round(cov, 6) AS token_coverage FROM c QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY cov DESC, score DESC, position) = 1""")
def evidence_choice(spark, sf_dir):
    """The line of each document that covers a question best."""
    hits = line_hits(spark, sf_dir)
    asked = model.gold(spark, sf_dir).where("query_id <= 10")
    lines = model.lines(authorized(spark, sf_dir)).select("doc_id", F.col("position").cast("long").alias("position"), "content")
    return answering.best_evidence(hits.join(asked, "query_id").join(lines, ["doc_id", "position"])).select("query_id", "doc_id", "position", "token_coverage")


@query()
def extractive_answers(spark, sf_dir):
    """Answers with numbered excerpts and citations for the first ten passages."""
    top = lexical.top(bm25_scored(spark, sf_dir, 3).where("query_id < 10"), 3, "score", "doc_id").select("query_id", "doc_id", "rank")
    docs = model.documents(spark, sf_dir).select("doc_id", "document_id", "content")
    return answering.answers(top.join(docs, "doc_id").join(model.gold(spark, sf_dir), "query_id")).select("query_id", F.length("answer").alias("characters"), "citations")


@query()
def rerank_stand_in(spark, sf_dir):
    """The rerank hook with word overlap for a model."""
    top = lexical.top(bm25_scored(spark, sf_dir, 20).where("query_id < 10"), 20, "score", "doc_id").select("query_id", "doc_id", "score")
    docs = model.documents(spark, sf_dir).select("doc_id", F.substring("content", 1, 680).alias("passage"))
    pool = top.join(docs, "doc_id").join(model.gold(spark, sf_dir), "query_id")
    return answering.scored_by(pool, answering.token_overlap).select("query_id", "doc_id", F.round("rerank", 6).alias("rerank"))


@query("""SELECT doc_id, 'see [restricted] and doc-' || doc_id || '0 or [restricted], not doc-' || doc_id || 'x' AS text FROM documents WHERE doc_id BETWEEN 1 AND 50""")
def redaction(spark, sf_dir):
    i = F.col("doc_id")
    t = F.concat(F.lit("see doc-"), i, F.lit(" and doc-"), i, F.lit("0 or secret.1, not doc-"), i, F.lit("x"))
    return model.table(spark, sf_dir, "documents").where("doc_id BETWEEN 1 AND 50").select("doc_id", answering.redacted(t, F.array(F.concat(F.lit("doc-"), i), F.lit("secret.1"))).alias("text"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split('# ' || lang || chr(10) || text || chr(10) || 'SUMMARY' || chr(10) || '2.1. Set up' || chr(10) || '3) ', chr(10))) AS line FROM documents), f AS (SELECT doc_id, trim(line) AS s, length(regexp_replace(trim(line), '[^A-Za-z]', '', 'g')) AS n, length(regexp_replace(trim(line), '[^A-Z]', '', 'g')) AS u FROM l)
 SELECT doc_id, count(*) AS headings FROM f WHERE regexp_matches(s, '^#{1,6}\s+\S') OR (regexp_matches(s, '^\d+(\.\d+){0,5}[.)]\s+\S') AND length(s) <= 160) OR (n >= 3 AND length(s) <= 80 AND u >= n * 0.9 AND NOT regexp_matches(s, '[.!?;]$')) GROUP BY doc_id""")
def section_headings(spark, sf_dir):
    framed = F.concat(F.lit("# "), "lang", F.lit("\n"), "text", F.lit("\nSUMMARY\n2.1. Set up\n3) "))
    l = model.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(framed, "\n")).alias("line"))
    return l.where(extraction.heading(F.col("line"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("headings"))


@query()
def section_parts(spark, sf_dir):
    return extraction.sections(model.documents(spark, sf_dir)).select("document_id", "ordinal", "title", "start", F.length("body").alias("characters"))


@query()
def rule_entities(spark, sf_dir):
    return extraction.entities(model.documents(spark, sf_dir)).select("document_id", "kind", "name", "start", "confidence")


@query()
def rule_relations(spark, sf_dir):
    notes = model.documents(spark, sf_dir).select("document_id", F.concat(F.lit("IBM MQ 9.1.0 and DataPower 10.5 fail, see swg2123"), F.col("doc_id") % 7, F.lit(". "), "content").alias("content"))
    return extraction.relations(extraction.entities(notes))


@query(f"""WITH d AS (SELECT 'doc-' || doc_id AS document_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents), f AS (SELECT document_id, t, regexp_extract(t, '^(.*?[.!?])( |$)', 1) AS s FROM d),
 e AS (SELECT document_id, substr(CASE WHEN length(s) >= 32 THEN s ELSE substr(t, 1, 320) END, 1, 600) AS event FROM f)
 SELECT document_id, event, least(16, len(list_filter(list_distinct(regexp_extract_all(lower(event), '{TOKEN}')), lambda t: length(t) > 2 AND NOT list_contains([{STOP}], t)))) AS n_entities FROM e""")
def event_extraction(spark, sf_dir):
    return extraction.events(model.documents(spark, sf_dir)).select("document_id", "event", F.size("entities").cast("long").alias("n_entities"))


@query()
def review_units(spark, sf_dir):
    return extraction.review_units(extraction.sections(model.documents(spark, sf_dir)), most=2000, overlap=100).select("document_id", "unit", F.length("text").alias("characters"))


@query("""SELECT * FROM (VALUES (1, TIMESTAMP '2024-01-02 03:04:05'), (2, TIMESTAMP '2024-01-02 01:04:05'), (3, TIMESTAMP '2024-01-02 00:00:00'), (4, TIMESTAMP '2000-01-01 00:00:00'), (5, TIMESTAMP '2000-01-01 00:00:00')) t(id, moment)""")
def temporal_parsing(spark, sf_dir):
    rows = spark.createDataFrame([(1, "2024-01-02T03:04:05Z"), (2, "2024-01-02T03:04:05+02:00"), (3, "2024-01-02"), (4, "  "), (5, "soon")], "id int, said string")
    return rows.select("id", extraction.utc(F.col("said"), F.lit("2000-01-01").cast("timestamp")).cast("timestamp_ntz").alias("moment"))


@query("SELECT * FROM (VALUES (1, 'yes', 0.5::DOUBLE), (2, NULL, NULL), (3, 'b', NULL)) t(id, verdict, score)")
def json_replies(spark, sf_dir):
    rows = spark.createDataFrame([(1, 'Sure:\n```json\n{"verdict": "yes", "score": 0.5}\n```'), (2, "no json {here"), (3, '{"verdict": "b"} ')], "id int, reply string")
    v = rows.select("id", extraction.json_of(F.col("reply")).alias("v"))
    return v.select("id", F.try_variant_get("v", "$.verdict", "string").alias("verdict"), F.try_variant_get("v", "$.score", "double").alias("score"))


@query(r"SELECT page_id, substr(regexp_replace(regexp_replace(trim(url), '[^A-Za-z0-9_.-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), 1, 128) AS name FROM pages")
def safe_names(spark, sf_dir):
    return model.table(spark, sf_dir, "pages").select("page_id", extraction.safe_name(F.col("url")).alias("name"))


@query("SELECT doc_id FROM documents WHERE source IN ('src1', 'src2') AND doc_id IN (SELECT doc_id FROM labels)")
def namespace_scope(spark, sf_dir):
    """An optional list of namespaces over the active projection; with a list and no projection nothing is read."""
    active = model.table(spark, sf_dir, "labels").select("doc_id")
    d = model.table(spark, sf_dir, "documents")
    return d.where(F.col("source").isin("src1", "src2")).join(active, "doc_id", "left_semi").select("doc_id")


@query("SELECT event_id AS assertion_id FROM events WHERE event_type IN ('click', 'error') AND user_id % 3 = 1 AND value > 5")
def assertion_filters(spark, sf_dir):
    a = model.assertions(spark, sf_dir)
    return a.where(F.col("predicate").isin("click", "error") & (F.col("subject_id") % 3 == 1) & (F.col("value") > 5)).select("assertion_id")
