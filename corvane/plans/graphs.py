"""Graph expansion, projections, hyperedges, multi-route fusion and context packs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import alike, dense, fusion, graph, lexical, packing
from corvane.plans.registry import AUTH, TOKEN, query
from corvane.plans.retrieval import BM25, PRINCIPAL, authorized, bm25_scored
from corvane.sources import model

#: Edges between documents, and the raw ones they are chosen from: three a document, some twice, some to themselves.
RAW = """raw AS (SELECT doc_id, k, 'doc-' || doc_id AS source_id, 'doc-' || ((doc_id * (7 + 3 * k) + k * 11) % (SELECT count(*) FROM documents)) AS target_id, CASE WHEN k = 2 THEN 'references' ELSE 'related_to' END AS relation,
  (50 + (doc_id * 13 + k * 29) % 50) / 100.0::DOUBLE AS confidence, doc_id * 3 + k AS seq FROM documents, (SELECT unnest([0, 1, 2]) AS k) ks)"""
EDGES = RAW + """, edges AS (SELECT source_id, target_id, relation, confidence, seq FROM raw WHERE source_id <> target_id
  QUALIFY row_number() OVER (PARTITION BY source_id, target_id, relation ORDER BY confidence DESC, seq) = 1)"""


def raw_edges(spark, sf_dir) -> DataFrame:
    d = model.table(spark, sf_dir, "documents")
    n = d.count()
    e = d.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    i, k = F.col("doc_id"), F.col("k")
    return e.select(
        F.concat(F.lit("doc-"), i).alias("source_id"), F.concat(F.lit("doc-"), (i * (7 + 3 * k) + k * 11) % n).alias("target_id"), F.when(k == 2, "references").otherwise("related_to").alias("relation"),
        ((50 + (i * 13 + k * 29) % 50) / 100.0).alias("confidence"), (i * 3 + k).alias("seq"))


@query(f"WITH {EDGES} SELECT source_id, target_id, relation, confidence FROM edges")
def strongest_edges(spark, sf_dir):
    return graph.strongest(raw_edges(spark, sf_dir)).select("source_id", "target_id", "relation", "confidence")


@query(f"WITH {EDGES} SELECT relation, count(*) AS n FROM edges GROUP BY relation ORDER BY relation")
def relation_counts(spark, sf_dir):
    return graph.strongest(raw_edges(spark, sf_dir)).groupBy("relation").agg(F.count(F.lit(1)).alias("n")).orderBy("relation")


@query(f"WITH {EDGES}, {AUTH}, ends AS (SELECT source_id AS node FROM edges UNION SELECT target_id FROM edges) SELECT node FROM ends WHERE node NOT IN (SELECT document_id FROM auth)")
def edge_validation(spark, sf_dir):
    """Endpoints that are no authorised document."""
    return graph.dangling(graph.strongest(raw_edges(spark, sf_dir)), authorized(spark, sf_dir))


PATHS = f"""WITH {EDGES}, {AUTH}, ok AS (SELECT e.* FROM edges e WHERE source_id IN (SELECT document_id FROM auth) AND target_id IN (SELECT document_id FROM auth)),
 seeds AS (SELECT doc_id // 25 AS query_id, document_id AS node, doc_id % 25 AS ord FROM auth WHERE doc_id % 25 < 2 AND doc_id < 500),
 h1 AS (SELECT query_id, [node, target_id] AS path, confidence, [ord, seq] AS ords, 1 AS hops FROM seeds JOIN ok ON source_id = node WHERE target_id <> node),
 h2 AS (SELECT query_id, list_append(path, e.target_id) AS path, h1.confidence * e.confidence AS confidence, list_append(ords, e.seq) AS ords, 2 AS hops FROM h1 JOIN ok e ON e.source_id = path[2] WHERE NOT list_contains(path, e.target_id)),
 allp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hops, ords) AS b FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) QUALIFY b <= 12),
 paths AS (SELECT query_id, path, confidence, hops, row_number() OVER (PARTITION BY query_id ORDER BY hops, round(confidence, 9) DESC, b) AS rank FROM allp)"""


def paths(spark, sf_dir) -> DataFrame:
    a = authorized(spark, sf_dir)
    seeds = a.where("doc_id % 25 < 2 AND doc_id < 500").select(F.floor(F.col("doc_id") / 25).alias("query_id"), F.col("document_id").alias("node"), (F.col("doc_id") % 25).alias("ord"))
    return graph.expand(graph.strongest(raw_edges(spark, sf_dir)), a.select("document_id"), seeds)


@query(PATHS + " SELECT query_id, array_to_string(path, '>') AS path, round(confidence, 6) AS confidence, hops, rank FROM paths")
def graph_two_hop(spark, sf_dir):
    return paths(spark, sf_dir).select("query_id", F.array_join("path", ">").alias("path"), F.round("confidence", 6).alias("confidence"), "hops", "rank")


GRAPHRAG = PATHS + """, hits AS (SELECT doc_id // 25 AS query_id, document_id, round(1.0::DOUBLE / (1 + doc_id % 25), 6) AS score, row_number() OVER (PARTITION BY doc_id // 25 ORDER BY doc_id) AS rank FROM auth WHERE doc_id < 500 QUALIFY rank <= 6),
 best AS (SELECT p.query_id, p.path[len(p.path)] AS document_id, round(h.score * p.confidence * pow(0.82, p.hops), 6) AS score, p.rank FROM paths p JOIN hits h ON h.query_id = p.query_id AND h.document_id = p.path[1]
   QUALIFY row_number() OVER (PARTITION BY p.query_id, p.path[len(p.path)] ORDER BY round(h.score * p.confidence * pow(0.82, p.hops), 6) DESC, p.rank) = 1),
 ev AS (SELECT * FROM best WHERE document_id IN (SELECT document_id FROM auth WHERE doc_id % 2 = 0)),
 alln AS (SELECT query_id, document_id, score, 'hit' AS mode, 0 AS bucket, rank FROM hits WHERE rank = 1 UNION ALL SELECT query_id, document_id, score, 'graph', 1, rank FROM ev UNION ALL SELECT query_id, document_id, score, 'hit', 2, rank FROM hits WHERE rank > 1),
 once AS (SELECT * FROM alln QUALIFY row_number() OVER (PARTITION BY query_id, document_id ORDER BY bucket, CASE WHEN bucket = 1 THEN -score ELSE 0 END, rank, document_id) = 1)
 SELECT query_id, document_id, score, mode, row_number() OVER (PARTITION BY query_id ORDER BY bucket, CASE WHEN bucket = 1 THEN -score ELSE 0 END, rank, document_id) AS place FROM once QUALIFY place <= 3"""


@query(GRAPHRAG)
def graph_rag_rank(spark, sf_dir):
    a = authorized(spark, sf_dir)
    q = F.floor(F.col("doc_id") / 25)
    hits = a.where("doc_id < 500").select(q.alias("query_id"), "document_id", F.round(1.0 / (1 + F.col("doc_id") % 25), 6).alias("score"), F.row_number().over(W.partitionBy(q).orderBy("doc_id")).alias("rank")).where("rank <= 6")
    evidence = a.where("doc_id % 2 = 0").select("document_id").crossJoin(hits.select("query_id").distinct())
    return graph.graph_ranked(hits, paths(spark, sf_dir), evidence)


RARE = f"""tok AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '{TOKEN}'))) AS entity FROM documents), ent AS (SELECT * FROM tok WHERE length(entity) >= 5),
 mem AS (SELECT doc_id, entity FROM ent WHERE entity IN (SELECT entity FROM ent GROUP BY entity HAVING count(*) BETWEEN 2 AND 20))"""


def members(spark, sf_dir) -> DataFrame:
    return graph.rare_terms(model.table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"""WITH {RARE}, pr AS (SELECT a.doc_id AS source, b.doc_id AS target, count(*) AS shared FROM mem a JOIN mem b USING (entity) WHERE a.doc_id <> b.doc_id GROUP BY ALL)
  SELECT source, target, shared, row_number() OVER (PARTITION BY source ORDER BY shared DESC, target) AS place FROM pr QUALIFY place <= 3""")
def shared_entity_edges(spark, sf_dir):
    return graph.shared_entity_edges(members(spark, sf_dir))


@query(f"""WITH {RARE}, s0 AS (SELECT DISTINCT doc_id FROM mem WHERE doc_id < 3), s1 AS (SELECT DISTINCT doc_id FROM mem WHERE entity IN (SELECT entity FROM mem WHERE doc_id IN (SELECT doc_id FROM s0)) AND doc_id NOT IN (SELECT doc_id FROM s0))
  SELECT doc_id, 0 AS hop FROM s0 UNION ALL SELECT doc_id, 1 FROM s1""")
def hyperedge_expand(spark, sf_dir):
    m = members(spark, sf_dir)
    return graph.hyperedges(m, m.where("doc_id < 3"), 1)


@query(r"""WITH t AS (SELECT doc_id, 'doc-' || doc_id AS document_id, 'See doc-' || ((doc_id * 7) % 1000) || ' and Doc-' || doc_id || ', also doc-999999. ' || source AS content FROM documents),
  r AS (SELECT document_id AS source_id, unnest(list_distinct(list_transform(regexp_extract_all(content, '(?i)doc-[0-9]+'), lambda x: lower(x)))) AS target_id, content FROM t)
  SELECT source_id, target_id, substr(content, greatest(1, instr(lower(content), target_id) - 110), length(target_id) + least(110, instr(lower(content), target_id) - 1) + 110) AS anchor
  FROM r WHERE target_id <> source_id AND target_id IN (SELECT document_id FROM t)""")
def reference_edges(spark, sf_dir):
    i = F.col("doc_id")
    d = model.table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), i).alias("document_id"), F.concat(F.lit("See doc-"), (i * 7) % 1000, F.lit(" and Doc-"), i, F.lit(", also doc-999999. "), "source").alias("content"))
    return graph.references(d)


@query(r"""WITH g AS (SELECT doc_id, lower(regexp_replace(text, '\s+', '', 'g')) AS f FROM documents),
  h AS (SELECT doc_id, f, string_split(f, '') AS h FROM g), k AS (SELECT doc_id, CASE WHEN length(f) >= 3 THEN list_distinct(list_transform(list_zip(h, h[2:], h[3:])[:-3], lambda z: z[1] || z[2] || z[3])) ELSE [f] END AS g FROM h),
  u AS (SELECT doc_id, unnest(g) AS t, len(g) AS n FROM k), df AS (SELECT t, count(*) AS df FROM u GROUP BY t),
  -- sets so alike share one of their rarest trigrams: all but the 88 % of a set that must be in the other, and one more
  p AS (SELECT doc_id, t, n FROM u JOIN df USING (t) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY df, t) <= n - ceil(n * 0.88) + 1),
  c AS (SELECT DISTINCT a.doc_id AS left_id, b.doc_id AS right_id FROM p a JOIN p b USING (t) WHERE a.doc_id < b.doc_id AND b.n BETWEEN a.n * 0.88 AND a.n / 0.88),
  m AS (SELECT left_id, right_id, len(list_intersect(a.g, b.g)) AS common, len(a.g) + len(b.g) AS total FROM c JOIN k a ON a.doc_id = left_id JOIN k b ON b.doc_id = right_id)
  SELECT left_id, right_id, round(common::DOUBLE / (total - common), 6) AS similarity FROM m WHERE common >= 0.88 * (total - common)""")
def near_duplicate_pairs(spark, sf_dir):
    """Trigram Jaccard of at least 0.88 (sets so alike are alike in size)."""
    return alike.pairs(model.table(spark, sf_dir, "documents"), "doc_id", "text")


# -- multi-route search: needs are the first five passages, events documents, a route's score BM25

ROUTE = f"""WITH {BM25}, need AS (SELECT query_id AS need_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, score / max(score) OVER (PARTITION BY query_id) AS norm FROM scored WHERE query_id < 5 QUALIFY rank <= 16)"""


def route(spark, sf_dir) -> DataFrame:
    """need_id, doc_id, score, rank, norm: the first 16 of each need."""
    s = bm25_scored(spark, sf_dir, 16).where("query_id < 5")
    r = lexical.top(s, 16, "score", "doc_id").withColumnRenamed("query_id", "need_id")
    return r.withColumn("norm", F.col("score") / F.max("score").over(W.partitionBy("need_id")))


@query(ROUTE + " SELECT need_id, doc_id, rank, round(norm, 6) AS norm FROM need")
def route_rank(spark, sf_dir):
    return route(spark, sf_dir).select("need_id", "doc_id", "rank", F.round("norm", 6).alias("norm"))


@query(ROUTE + " SELECT need_id, doc_id, round(0.5 + 0.5 * norm, 6) AS support FROM need WHERE rank = 1 OR norm >= 0.72")
def relative_judge(spark, sf_dir):
    return route(spark, sf_dir).where("rank = 1 OR norm >= 0.72").select("need_id", "doc_id", F.round(0.5 + 0.5 * F.col("norm"), 6).alias("support"))


FUSED = ROUTE + """, sup AS (SELECT need_id, doc_id, rank, norm, 0.5 + 0.5 * norm AS support, 1.0 + need_id * 0.25 AS weight FROM need WHERE rank = 1 OR norm >= 0.72),
 fused AS (SELECT doc_id, round(sum(weight * (0.55 * 11 / (10 + rank) + 0.45 * norm) * support) / (SELECT sum(1.0 + n * 0.25) FROM range(0, 5) r(n)), 6) AS score, count(*) AS needs FROM sup GROUP BY doc_id)"""


def fused(spark, sf_dir) -> DataFrame:
    w = 1.0 + F.col("need_id") * 0.25
    total = sum(1.0 + n * 0.25 for n in range(5))
    part = w * (0.55 * 11 / (10 + F.col("rank")) + 0.45 * F.col("norm")) * (0.5 + 0.5 * F.col("norm"))
    return route(spark, sf_dir).where("rank = 1 OR norm >= 0.72").groupBy("doc_id").agg(F.round(F.sum(part) / total, 6).alias("score"), F.count(F.lit(1)).alias("needs"))


@query(FUSED + " SELECT doc_id, score, needs FROM fused")
def coverage_fusion(spark, sf_dir):
    return fused(spark, sf_dir)


@query(ROUTE + """, sup AS (SELECT DISTINCT need_id FROM need WHERE rank = 1 AND score > 0), pk AS (SELECT DISTINCT need_id FROM need WHERE rank = 1 AND doc_id % 2 = 0)
  SELECT n.item_id AS need_id, CASE WHEN p.need_id IS NOT NULL THEN 'covered' WHEN s.need_id IS NOT NULL THEN 'token-budget-exceeded' ELSE 'no-validated-evidence' END AS status FROM benchmark n LEFT JOIN sup s ON s.need_id = n.item_id LEFT JOIN pk p ON p.need_id = n.item_id WHERE n.item_id < 8""")
def need_coverage_report(spark, sf_dir):
    first = route(spark, sf_dir).where("rank = 1 AND score > 0")
    needs = model.gold(spark, sf_dir).where("query_id < 8").select(F.col("query_id").alias("need_id"))
    s, p = first.select("need_id", F.lit(True).alias("s")), first.where("doc_id % 2 = 0").select("need_id", F.lit(True).alias("p"))
    return needs.join(s, "need_id", "left").join(p, "need_id", "left").select("need_id", F.when(F.col("p"), "covered").when(F.col("s"), "token-budget-exceeded").otherwise("no-validated-evidence").alias("status"))


PACK = BM25 + f""", t AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= 8),
 tk AS (SELECT t.*, CAST(len(regexp_extract_all(lower(d.text), '{TOKEN}')) AS BIGINT) AS tokens FROM t JOIN documents d USING (doc_id))"""


def packed_hits(spark, sf_dir) -> DataFrame:
    t = lexical.top(bm25_scored(spark, sf_dir, 8), 8, "score", "doc_id").select("query_id", "doc_id", "rank")
    size = model.table(spark, sf_dir, "documents").select("doc_id", F.size(T.retrieval_tokens(F.col("text"))).cast("long").alias("tokens"))
    return t.join(size, "doc_id")


@query(f"WITH {PACK}, c AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM tk) SELECT query_id, doc_id, rank, tokens, least(tokens, 1000 - before)::BIGINT AS taken FROM c WHERE before < 1000")
def pack_truncate(spark, sf_dir):
    return packing.truncating(packed_hits(spark, sf_dir), 1000).select("query_id", "doc_id", "rank", "tokens", "taken")


@query(f"""WITH RECURSIVE {PACK}, walk AS (SELECT query_id, 0::BIGINT AS rank, 0::BIGINT AS used, []::BIGINT[] AS kept FROM (SELECT DISTINCT query_id FROM tk) UNION ALL
  SELECT w.query_id, tk.rank, CASE WHEN used + tokens <= 1000 THEN used + tokens ELSE used END, CASE WHEN used + tokens <= 1000 THEN list_append(kept, tk.doc_id) ELSE kept END FROM walk w JOIN tk ON tk.query_id = w.query_id AND tk.rank = w.rank + 1),
  fin AS (SELECT query_id, arg_max(used, rank) AS used, arg_max(kept, rank) AS kept FROM walk GROUP BY query_id)
  SELECT query_id, used, unnest(kept) AS doc_id, generate_subscripts(kept, 1) - 1 AS place FROM fin""")
def pack_skip(spark, sf_dir):
    return packing.skipping(packed_hits(spark, sf_dir), 1000, "doc_id").select("query_id", "used", "doc_id", "place")


def coverage_select(spark, sf_dir):
    """The best five by score without near-duplicates among a query's first eight."""
    hits = lexical.top(bm25_scored(spark, sf_dir, 8).where("query_id < 10"), 8, "score", "doc_id")
    grams = model.table(spark, sf_dir, "documents").select("doc_id", T.char_grams(F.col("text")).alias("grams"))
    return packing.covering(hits.join(grams, "doc_id").select("query_id", F.col("doc_id").alias("document_id"), "score", "grams"), 5)


query(f"""WITH RECURSIVE {BM25}, t AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE query_id < 10 QUALIFY rank <= 8),
 g AS (SELECT t.*, list_distinct(list_transform(range(1, length(f) - 1), lambda i: substr(f, i, 3))) AS g FROM (SELECT t.*, lower(regexp_replace(d.text, '\\s+', '', 'g')) AS f FROM t JOIN documents d USING (doc_id)) t),
 sim AS (SELECT a.query_id, a.rank AS ra, b.rank AS rb FROM g a JOIN g b ON a.query_id = b.query_id AND a.rank < b.rank WHERE len(list_intersect(a.g, b.g)) >= 0.88 * len(list_distinct(list_concat(a.g, b.g)))),
 walk AS (SELECT query_id, 0::BIGINT AS rank, []::BIGINT[] AS kept FROM (SELECT DISTINCT query_id FROM t) UNION ALL SELECT w.query_id, t.rank,
  CASE WHEN len(kept) < 5 AND NOT EXISTS (SELECT 1 FROM sim s WHERE s.query_id = w.query_id AND s.rb = t.rank AND list_contains(w.kept, s.ra)) THEN list_append(kept, t.rank) ELSE kept END FROM walk w JOIN t ON t.query_id = w.query_id AND t.rank = w.rank + 1),
 fin AS (SELECT query_id, arg_max(kept, rank) AS kept FROM walk GROUP BY query_id), o AS (SELECT query_id, unnest(kept) AS rank, generate_subscripts(kept, 1) AS place FROM fin)
 SELECT o.query_id, t.doc_id AS document_id, o.place FROM o JOIN t USING (query_id, rank)""")(coverage_select)


MULTI = f"""WITH {RARE}, qv AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7), cosn AS (SELECT d.doc_id, round(greatest(0.0, list_dot_product(e.embedding::DOUBLE[], q)), 6) AS event_score FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id % 500, qv),
 seed AS (SELECT doc_id FROM cosn ORDER BY event_score DESC, doc_id LIMIT 24), near AS (SELECT DISTINCT doc_id FROM mem WHERE entity IN (SELECT entity FROM mem WHERE doc_id IN (SELECT doc_id FROM seed)) AND doc_id NOT IN (SELECT doc_id FROM seed)),
 reach AS (SELECT doc_id, 0 AS hop FROM seed UNION ALL SELECT doc_id, 1 FROM near), sc AS (SELECT doc_id, hop, round(0.42 * event_score + CASE WHEN hop > 0 THEN 0.12 * pow(0.75, hop - 1) ELSE 0 END, 8) AS score FROM reach JOIN cosn USING (doc_id))
 SELECT doc_id, hop, score FROM sc ORDER BY score DESC, doc_id LIMIT 80"""


@query(MULTI)
def multi_route_search(spark, sf_dir):
    """One route: seeds by vector, their neighbours over shared entities, one pool of 80."""
    v = model.vectors(spark, sf_dir)
    q = v.where("vec_id = 7").select(F.lit(0).alias("query_id"), F.col("v").alias("q"))
    rows = model.table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 500).alias("vec_id")).join(v.select("vec_id", "v"), "vec_id").select(F.col("doc_id").alias("vec_id"), "v")
    s = dense.scored(rows, q).select(F.col("vec_id").alias("doc_id"), F.col("score").alias("event_score"))
    seeds = s.orderBy(F.desc("event_score"), "doc_id").limit(24).select("doc_id")
    reach = graph.hyperedges(members(spark, sf_dir), seeds, 1)
    bonus = F.when(F.col("hop") > 0, 0.12 * F.pow(F.lit(0.75), F.col("hop") - 1)).otherwise(0.0)
    return reach.join(s, "doc_id").select("doc_id", "hop", F.round(0.42 * F.col("event_score") + bonus, 8).alias("score")).orderBy(F.desc("score"), "doc_id").limit(80)
