"""Access control, lexical, dense and hybrid retrieval over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import dense, evaluation, fusion, hybrid, lexical, security
from corvane.plans.registry import AUTH, DOCS, TOKEN, query
from corvane.sources import model

PRINCIPAL = ["en", "fr"]


def authorized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security.authorized(model.documents(spark, sf_dir), PRINCIPAL)


@query(f"WITH {AUTH} SELECT document_id, business_class FROM auth")
def acl_authorized_docs(spark, sf_dir):
    return authorized(spark, sf_dir).select("document_id", "business_class")


@query(f"WITH {AUTH} SELECT document_id FROM docs WHERE document_id NOT IN (SELECT document_id FROM auth)")
def acl_restricted_ids(spark, sf_dir):
    return security.restricted_ids(model.documents(spark, sf_dir), PRINCIPAL)


@query(f"WITH {DOCS} SELECT document_id FROM docs WHERE false")
def acl_no_roles_deny(spark, sf_dir):
    return security.authorized(model.documents(spark, sf_dir), []).select("document_id")


@query(f"WITH {AUTH} SELECT document_id FROM auth WHERE business_class = 'src3'")
def acl_tenant_gate(spark, sf_dir):
    docs = model.documents(spark, sf_dir).withColumn("tenant_id", F.col("business_class"))
    return security.authorized(docs, PRINCIPAL, "src3").select("document_id")


@query(f"""WITH {DOCS} SELECT document_id, '|' || array_to_string(list_sort(allowed_roles), '|') || '|' AS roles_text,
  '|' || array_to_string(list_transform(list_sort(allowed_roles), lambda r: lower(hex(r))), '|') || '|' AS roles_key,
  contains('|' || array_to_string(list_sort(allowed_roles), '|') || '|', '|restricted|') AS has_restricted FROM docs""")
def role_encoding(spark, sf_dir):
    r = F.col("allowed_roles")
    return model.documents(spark, sf_dir).select(
        "document_id", security.encoded_roles(r).alias("roles_text"), security.encoded_keys(r).alias("roles_key"), F.contains(security.encoded_roles(r), F.lit("|restricted|")).alias("has_restricted"))


@query(f"""WITH {AUTH} SELECT document_id, title, count(*) OVER () AS total FROM auth WHERE contains(lower(title || ' ' || document_id || ' ' || business_class), 'on')
  ORDER BY title, document_id LIMIT 20 OFFSET 10""")
def catalog_page(spark, sf_dir):
    hay = F.lower(F.concat_ws(" ", "title", "document_id", "business_class"))
    met = authorized(spark, sf_dir).where(F.contains(hay, F.lit("on"))).select("document_id", "title")
    total = met.agg(F.count(F.lit(1)).alias("total"))
    return met.orderBy("title", "document_id").offset(10).limit(20).join(F.broadcast(total))  # one row


@query(f"""WITH {AUTH}, t AS (SELECT document_id, lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) AS t FROM auth),
  q AS (SELECT doc_id AS query_id, 'what does ' || lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) || ' say' AS q FROM docs WHERE doc_id % 50 = 0)
  SELECT query_id, t.document_id, row_number() OVER (PARTITION BY query_id ORDER BY length(t.t) DESC, t.document_id) AS place FROM q JOIN t ON t.t <> '' AND contains(q, t.t)""")
def title_in_query(spark, sf_dir):
    """Authorised documents whose title a question quotes, longest titles first."""
    titles = authorized(spark, sf_dir).select("document_id", F.lower(T.collapse(F.col("title"))).alias("t")).where("t <> ''")
    asked = model.documents(spark, sf_dir).where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.concat(F.lit("what does "), F.lower(T.collapse(F.col("title"))), F.lit(" say")).alias("q"))
    # a title stands in a question, within words too, only where its first eight characters do: these are looked up by equality, and no title meets every question
    heads = F.flatten(F.transform(F.sequence(F.lit(1), F.length("q")), lambda i: F.transform(F.sequence(F.lit(1), F.lit(8)), lambda n: F.substring("q", i, n))))
    distinct = titles.select("t").distinct().withColumn("head", F.substring("t", 1, 8))
    quoted = asked.select("query_id", "q", F.explode(F.array_distinct(heads)).alias("head")).join(distinct, "head").where(F.contains("q", "t")).select("query_id", "t")
    met = quoted.join(titles, "t")
    return met.select("query_id", "document_id", F.row_number().over(W.partitionBy("query_id").orderBy(F.length("t").desc(), "document_id")).alias("place"))


@query(f"""SELECT doc_id, len(regexp_extract_all(lower(text), '{TOKEN}')) AS tokens, len(list_distinct(regexp_extract_all(lower(text), '{TOKEN}'))) AS terms FROM documents""")
def retrieval_tokens(spark, sf_dir):
    t = T.retrieval_tokens(F.col("text"))
    return model.table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("tokens"), F.size(F.array_distinct(t)).cast("long").alias("terms"))


@query(r"""SELECT doc_id, CAST(coalesce(list_sum(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+(?:[._:/-][A-Za-z0-9]+)*|[\x{3400}-\x{9fff}]|[^\s]'),
  lambda t: CASE WHEN length(t) <= 24 THEN 1 ELSE CAST(ceil(length(t) / 16.0) AS INTEGER) END)), 0) AS BIGINT) AS units FROM documents""")
def budget_token_counts(spark, sf_dir):
    return model.table(spark, sf_dir, "documents").select("doc_id", T.budget_tokens(F.col("text")).cast("long").alias("units"))


@query(r"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '(^|[^A-Za-z0-9])([vV]?\d+\.\d+(?:\.\d+)*)', 2), lambda x: lower(x)))), ',') AS versions
  FROM documents WHERE regexp_matches(text, '(^|[^A-Za-z0-9])([vV]?\d+\.\d+(?:\.\d+)*)([^A-Za-z0-9]|$)')""")
def version_features(spark, sf_dir):
    d = model.table(spark, sf_dir, "documents").select("doc_id", T.versions(F.col("text")).alias("v"))
    return d.where(F.size("v") > 0).select("doc_id", F.array_join("v", ",").alias("versions"))


def _questions(spark):
    return model.literal_rows(spark, "query_id int, query string, document string", [
        (1, "DataPower jms reports mqrc_not_authorized on version 10.5.0", "IBM DataPower 10.5.0 with JMS returns MQRC_NOT_AUTHORIZED"),
        (2, "How do I fix error ABC-1234 in WAS 8.5", "WebSphere Application Server 8.5 known issues"),
        (3, "MQ 2035 and swg21234567", "WebSphere MQ 2035, see swg21234567 or NullPointerException"),
        (4, "plain question without anything", "text"),
    ])


@query("""SELECT * FROM (VALUES (1, 'datapower', 'jms', 'mqrc_not_authorized', '10.5.0', 0.2::DOUBLE), (2, 'websphere-application-server', '', 'abc-1234', '8.5', 0.12::DOUBLE),
  (3, 'ibm-mq', '', 'mq 2035,swg21234567', '', 0.2::DOUBLE), (4, '', '', '', '', 0.0::DOUBLE)) t(query_id, products, components, identifiers, versions, boost)""")
def identifier_features(spark, sf_dir):
    f = _questions(spark).withColumn("f", T.features(F.col("query"))).withColumn("d", T.features(F.col("document")))
    return f.select("query_id", *[F.array_join(f"f.{p}", ",").alias(p) for p in ("products", "components", "identifiers", "versions")], F.round(T.feature_boost(F.col("f"), F.col("d")), 6).alias("boost"))


BM25 = f"""{AUTH}, terms AS (SELECT DISTINCT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '{TOKEN}'))) AS term FROM benchmark),
 toks AS (SELECT doc_id, unnest(regexp_extract_all(lower(content), '{TOKEN}')) AS term FROM auth), lens AS (SELECT doc_id, len(regexp_extract_all(lower(content), '{TOKEN}')) AS len FROM auth),
 post AS (SELECT doc_id, term, count(*) AS tf FROM toks WHERE term IN (SELECT term FROM terms) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
 corp AS (SELECT count(*) AS n, avg(len) AS avgdl FROM lens),
 raw AS (SELECT t.query_id, p.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / greatest(avgdl, 1.0)))) AS raw
  FROM post p JOIN df USING (term) JOIN lens USING (doc_id) JOIN terms t USING (term) CROSS JOIN corp GROUP BY ALL),
 scored AS (SELECT query_id, doc_id, round(CASE WHEN max(raw) OVER (PARTITION BY query_id) > 0 THEN raw / max(raw) OVER (PARTITION BY query_id) ELSE 0 END, 6) AS score FROM raw)"""


def bm25_scored(spark, sf_dir, best, principal=None):
    """query_id, doc_id, score: what can be among the `best` first documents of a question."""
    docs = security.authorized(model.documents(spark, sf_dir), principal or PRINCIPAL)
    raw = lexical.bm25_best(docs.select("doc_id", "content"), model.gold(spark, sf_dir), best)
    return lexical.max_normalised(raw).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {BM25} SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= 10")
def bm25_top(spark, sf_dir):
    return lexical.top(bm25_scored(spark, sf_dir, 10), 10, "score", "doc_id")


@query(f"WITH {BM25.replace(chr(39) + 'en' + chr(39) + ', ' + chr(39) + 'fr' + chr(39), chr(39) + 'de' + chr(39))} SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= 10")
def bm25_acl_shift(spark, sf_dir):
    """The same questions for another principal: other statistics, other scores."""
    return lexical.top(bm25_scored(spark, sf_dir, 10, ["de"]), 10, "score", "doc_id")


MRR = f"""WITH {BM25}, top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= 3),
 rel AS (SELECT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
 hit AS (SELECT query_id, count(*) AS found, min(rank) AS first, sum(1.0 / log2(rank + 1.0)) AS dcg FROM top JOIN rel USING (query_id, doc_id) GROUP BY query_id),
 nrel AS (SELECT query_id, count(*) AS n_rel FROM rel GROUP BY query_id)
 SELECT b.item_id AS query_id, round(coalesce(found::DOUBLE / n_rel, 0), 6) AS recall, round(coalesce(1.0::DOUBLE / first, 0), 6) AS reciprocal_rank,
  round(coalesce(dcg / (1.0::DOUBLE + CASE WHEN n_rel >= 2 THEN 1 / log2(3.0) ELSE 0 END + CASE WHEN n_rel >= 3 THEN 0.5 ELSE 0 END), 0), 6) AS ndcg
 FROM benchmark b LEFT JOIN nrel ON nrel.query_id = b.item_id LEFT JOIN hit ON hit.query_id = b.item_id"""


def relevant(spark, sf_dir) -> DataFrame:
    """(query_id, document_id = doc_id): documents that hold the whole passage."""
    docs = model.table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical.containing(docs, model.gold(spark, sf_dir)).withColumnRenamed("doc_id", "document_id")


@query(MRR)
def flagship_bm25_mrr(spark, sf_dir):
    ranked = lexical.top(bm25_scored(spark, sf_dir, 3), 3, "score", "doc_id").withColumnRenamed("doc_id", "document_id")
    return evaluation.ranked_measures(ranked, relevant(spark, sf_dir), model.gold(spark, sf_dir))


TITLED = f"""{AUTH}, q AS (SELECT item_id AS query_id, text AS query FROM benchmark WHERE item_id <= 5),
 terms AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(lower(query), '{TOKEN}'))) AS term FROM q),
 hay AS (SELECT doc_id, title, title || ' ' || content AS h FROM auth), toks AS (SELECT doc_id, unnest(regexp_extract_all(lower(h), '{TOKEN}')) AS term FROM hay),
 lens AS (SELECT doc_id, len(regexp_extract_all(lower(h), '{TOKEN}')) AS len FROM hay), tt AS (SELECT doc_id, unnest(regexp_extract_all(lower(title), '{TOKEN}')) AS term FROM hay),
 ttf AS (SELECT doc_id, term, count(*) AS tft FROM tt GROUP BY ALL), post0 AS (SELECT doc_id, term, count(*) AS tf FROM toks GROUP BY ALL),
 post AS (SELECT p.doc_id, p.term, tf + 1.5 * coalesce(tft, 0) AS tf FROM post0 p LEFT JOIN ttf USING (doc_id, term)), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
 corp AS (SELECT count(*) AS n, avg(len) AS avgdl FROM lens),
 raw0 AS (SELECT t.query_id, p.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / greatest(avgdl, 1.0)))) AS raw
  FROM post p JOIN df USING (term) JOIN lens USING (doc_id) JOIN terms t USING (term) CROSS JOIN corp GROUP BY ALL),
 bon AS (SELECT q.query_id, h.doc_id, CASE WHEN contains(lower(h.h), lower(trim(q.query))) THEN 4.0 ELSE 0 END + CASE WHEN contains(lower(q.query), lower(trim(h.title))) THEN 12.0 ELSE 0 END AS bonus FROM q, hay h),
 raw AS (SELECT query_id, doc_id, raw + coalesce(bonus, 0) AS raw FROM raw0 LEFT JOIN bon USING (query_id, doc_id))"""


@query(f"""WITH {TITLED}, n AS (SELECT query_id, doc_id, round(raw / max(raw) OVER (PARTITION BY query_id), 6) AS score FROM raw)
  SELECT query_id, doc_id, score FROM n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10""")
def bm25_title_boost(spark, sf_dir):
    docs = authorized(spark, sf_dir).select("doc_id", "title", "content")
    asked = model.gold(spark, sf_dir).where("query_id <= 5")
    raw = lexical.bm25(docs, asked, title="title").join(lexical.bonuses(docs, asked), ["query_id", "doc_id"], "left")
    scored = lexical.max_normalised(raw.withColumn("raw", F.col("raw") + F.coalesce("bonus", F.lit(0.0)))).select("query_id", "doc_id", F.round("score", 6).alias("score"))
    return lexical.top(scored, 10, "score", "doc_id").drop("rank")


@query(r"""SELECT doc_id, count(*) AS hits FROM (SELECT doc_id, unnest(['swg21234567', '2.0', '4.0']) AS ident, lower(text) AS t FROM documents) WHERE contains(t, ident) GROUP BY doc_id""")
def exact_prefilter(spark, sf_dir):
    """Exact mode: documents that hold one of a question's identifiers."""
    ids = F.array(*[F.lit(x) for x in ("swg21234567", "2.0", "4.0")])
    hay = model.table(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(ids, lambda i: F.contains(F.lower("text"), i))).cast("long").alias("hits"))
    return hay.where("hits > 0")


NEAR = """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id < 5), s AS (SELECT query_id, e.vec_id, round(greatest(0.0, list_dot_product(e.embedding::DOUBLE[], q)), 6) AS score
  FROM embeddings e, q WHERE query_id <> e.vec_id)"""


def _asked(spark, sf_dir):
    v = model.vectors(spark, sf_dir)
    return v, v.where("vec_id < 5").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))


@query(NEAR + " SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10")
def dense_topk(spark, sf_dir):
    v, q = _asked(spark, sf_dir)
    return dense.nearest(v, q, 10)


@query(NEAR + " SELECT vec_id, max(score) AS best, arg_max(query_id, (score, -query_id)) AS query_id FROM s GROUP BY vec_id ORDER BY best DESC, vec_id LIMIT 8")
def entity_matrix_top(spark, sf_dir):
    """Every entity's best match among several analysed query vectors; the best eight."""
    v, q = _asked(spark, sf_dir)
    s = dense.scored(v, q).where("query_id <> vec_id")
    best = s.groupBy("vec_id").agg(F.max("score").alias("best"), F.max_by("query_id", F.struct("score", -F.col("query_id"))).alias("query_id"))
    return best.orderBy(F.desc("best"), "vec_id").limit(8)


HYBRID = f"""WITH {BM25}, dv AS (SELECT a.doc_id, e.embedding::DOUBLE[] AS v FROM auth a JOIN embeddings e ON e.vec_id = a.doc_id % 500), qv AS (SELECT b.item_id AS query_id, e.embedding::DOUBLE[] AS q FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id + 100),
 den AS (SELECT query_id, doc_id, round(greatest(0.0, list_dot_product(v, q)), 6) AS dense FROM dv, qv),
 hyb AS (SELECT query_id, doc_id, coalesce(s.score, 0) AS lexical, dense, round(0.5 * coalesce(s.score, 0) + 0.5 * dense, 7) AS score FROM den LEFT JOIN scored s USING (query_id, doc_id))"""


def hybrid_sides(spark, sf_dir):
    """Authorised documents and questions with their vectors, which are joined by id modulo 500."""
    v = model.vectors(spark, sf_dir)
    docs = authorized(spark, sf_dir).select("doc_id", "content", (F.col("doc_id") % 500).alias("k")).join(v.select(F.col("vec_id").alias("k"), "v"), "k", "left").select("doc_id", "content", "v")
    asked = model.gold(spark, sf_dir).withColumn("k", F.col("query_id") + 100).join(v.select(F.col("vec_id").alias("k"), F.col("v").alias("q")), "k", "left").select("query_id", "query", "q")
    return docs, asked


@query(HYBRID + " SELECT query_id, doc_id, lexical, dense, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM hyb WHERE score >= 0.12 QUALIFY rank <= 5")
def hybrid_score(spark, sf_dir):
    return lexical.top(hybrid.pool(*hybrid_sides(spark, sf_dir), 5).where("score >= 0.12"), 5, "score", "doc_id").select("query_id", "doc_id", "lexical", "dense", "score", "rank")


@query(HYBRID + """, b AS (SELECT query_id, doc_id, 0.5 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, doc_id)) AS p FROM hyb WHERE lexical > 0
   UNION ALL SELECT query_id, doc_id, 0.5 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, doc_id)) FROM hyb WHERE dense > 0), f AS (SELECT query_id, doc_id, sum(p) AS raw FROM b GROUP BY ALL),
   n AS (SELECT query_id, doc_id, round(raw / max(raw) OVER (PARTITION BY query_id), 6) AS score FROM f)
   SELECT query_id, doc_id, score FROM n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 5""")
def rrf_fusion(spark, sf_dir):
    fused = hybrid.rank_fused(*hybrid_sides(spark, sf_dir), 5).select("query_id", "doc_id", F.round("score", 6).alias("score"))
    return lexical.top(fused, 5, "score", "doc_id").drop("rank")


@query(HYBRID + """, b AS (SELECT query_id, doc_id, score, lexical, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS base_rank FROM hyb QUALIFY base_rank <= 20),
   r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, base_rank) AS rerank_rank FROM b)
   SELECT query_id, doc_id, base_rank, rerank_rank, row_number() OVER (PARTITION BY query_id ORDER BY round(0.5 / (60 + base_rank) + 0.5 / (60 + rerank_rank), 9) DESC, base_rank) AS final_rank FROM r""")
def rerank_weighted_rrf(spark, sf_dir):
    pool = lexical.top(hybrid.pool(*hybrid_sides(spark, sf_dir), 20), 20, "score", "doc_id").drop("rank").withColumn("rerank", F.col("lexical"))
    return fusion.reranked(pool, "doc_id", "weighted_rrf").select("query_id", "doc_id", "base_rank", "rerank_rank", "final_rank")


@query(HYBRID + """, b AS (SELECT query_id, doc_id, lexical, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS base_rank FROM hyb QUALIFY base_rank <= 20)
   SELECT query_id, doc_id, base_rank, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, base_rank) AS final_rank FROM b""")
def rerank_replace(spark, sf_dir):
    pool = lexical.top(hybrid.pool(*hybrid_sides(spark, sf_dir), 20), 20, "score", "doc_id").drop("rank").withColumn("rerank", F.col("lexical"))
    return fusion.reranked(pool, "doc_id", "replace").select("query_id", "doc_id", "base_rank", "final_rank")


LINES = f"""WITH {AUTH}, ln AS (SELECT doc_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS position FROM auth),
 q AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '{TOKEN}')) AS qt FROM benchmark WHERE item_id <= 10),
 h AS (SELECT query_id, doc_id, position, round(len(list_intersect(qt, regexp_extract_all(lower(line), '{TOKEN}')))::DOUBLE / len(qt), 6) AS score FROM ln, q), hits AS (SELECT * FROM h WHERE score > 0.1)"""


def line_hits(spark, sf_dir):
    """Lines as chunks, scored by the share of a question's tokens they hold."""
    chunks = model.lines(authorized(spark, sf_dir)).select("doc_id", "position", T.retrieval_tokens(F.col("content")).alias("t"))
    asked = model.gold(spark, sf_dir).where("query_id <= 10").select("query_id", F.array_distinct(T.retrieval_tokens(F.col("query"))).alias("qt"))
    hit = chunks.join(asked, F.lit(True)).select("query_id", "doc_id", F.col("position").cast("long").alias("position"), F.round(F.size(F.array_intersect("qt", "t")) / F.size("qt"), 6).alias("score"))
    return hit.where("score > 0.1")


@query(LINES + """, best AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, doc_id, position) AS n FROM hits QUALIFY n = 1)
  SELECT query_id, doc_id, position, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, position) AS rank FROM best QUALIFY rank <= 3""")
def distinct_documents_topk(spark, sf_dir):
    return fusion.best_per_document(line_hits(spark, sf_dir), "doc_id", 3, F.desc("score"), F.col("doc_id"), F.col("position"))


@query(LINES + """, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, position) AS rn FROM hits), f AS (SELECT *, min(rn) OVER (PARTITION BY query_id, doc_id) AS first FROM r),
  d AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY first) AS doc_rank, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rn) AS hit_rank FROM f)
  SELECT query_id, doc_id, position, score, doc_rank, hit_rank FROM d WHERE doc_rank <= 5 AND hit_rank <= 3""")
def doc_candidates_n_m(spark, sf_dir):
    return fusion.candidates(line_hits(spark, sf_dir), "doc_id", 5, 3, F.desc("score"), F.col("doc_id"), F.col("position")).select("query_id", "doc_id", "position", "score", "doc_rank", "hit_rank")


@query(LINES + """, lo AS (SELECT a.doc_id FROM auth a WHERE a.doc_id % 5 = 0), m AS (SELECT query_id, h.doc_id, max(score) AS score FROM hits h JOIN lo USING (doc_id) GROUP BY ALL)
  SELECT query_id, doc_id, score FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 3""")
def candidate_allow_list(spark, sf_dir):
    """Search restricted to an allow-list of documents."""
    allowed = authorized(spark, sf_dir).where("doc_id % 5 = 0").select("doc_id")
    met = security.among(line_hits(spark, sf_dir), allowed, "doc_id").groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    return lexical.top(met, 3, "score", "doc_id").drop("rank")
