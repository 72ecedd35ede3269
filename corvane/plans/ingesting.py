"""Parsing, chunking, extraction and knowledge-graph dataflow over the given tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import answering, chunking, knowledge
from corvane.plans.registry import DOCS, TOKEN, query, statement
from corvane.sources import model, parsing


@query(r"""SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title, len(regexp_extract_all(html, '(?is)<h[1-6][^>]*>')) AS headings, len(regexp_extract_all(html, '(?is)<li[ >]')) AS items FROM pages""")
def html_titles_headings(spark, sf_dir):
    n = lambda p: F.size(T.found(F.col("html"), p)).cast("long")
    return model.table(spark, sf_dir, "pages").select("page_id", T.collapse(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), n(r"(?is)<h[1-6][^>]*>").alias("headings"), n(r"(?is)<li[ >]").alias("items"))


@query()
def html_blocks(spark, sf_dir):
    """The parser itself: blocks of each page."""
    files = model.table(spark, sf_dir, "pages").select(F.concat(F.lit("page-"), "page_id", F.lit(".html")).alias("path"), F.encode("html", "utf-8").alias("content"))
    p = parsing.parse(files)
    return p.select("path", "title", "failed", F.size("blocks").alias("n_blocks"), F.size("suppressed").alias("n_suppressed"), F.size(F.filter("blocks", lambda b: b["kind"] == "heading")).alias("n_headings"))


@query("""WITH u AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url || '.html' WHEN 1 THEN url || '.PDF' WHEN 2 THEN url || '.docx' WHEN 3 THEN url || '.md' ELSE url || '.zip9' END AS p FROM pages),
 e AS (SELECT page_id, lower(regexp_extract(p, '\\.([A-Za-z0-9]+)$', 1)) AS x FROM u) SELECT page_id, CASE x WHEN 'html' THEN 'html' WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'docx' WHEN 'md' THEN 'markdown' END AS format FROM e""".replace("\\\\", "\\"))
def format_detection(spark, sf_dir):
    tail = F.element_at(F.array(*[F.lit(x) for x in (".html", ".PDF", ".docx", ".md", ".zip9")]), (F.col("page_id") % 5 + 1).cast("int"))
    return model.table(spark, sf_dir, "pages").select("page_id", parsing.format_of(F.concat("url", tail)).alias("format"))


KINDS = r"""CASE WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(trim(line), '^#{1,6}\s+\S') THEN 'heading' WHEN regexp_matches(trim(line), '^([-*+]|\d+[.)])\s+\S') THEN 'list_item' WHEN contains(line, '|') THEN 'table' ELSE 'paragraph' END"""


@query(f"WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) SELECT {KINDS} AS kind, count(*) AS n FROM l GROUP BY 1")
def line_kinds(spark, sf_dir):
    line, s = F.col("line"), F.trim("line")
    kind = F.when(s == "", "blank").when(s.rlike(r"^#{1,6}\s+\S"), "heading").when(s.rlike(r"^([-*+]|\d+[.)])\s+\S"), "list_item").when(F.contains(line, F.lit("|")), "table").otherwise("paragraph")
    return model.table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line")).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos, len(ls) AS n FROM p),
 e AS (SELECT DISTINCT doc_id, trim(regexp_replace(line, '\s+', ' ', 'g')) AS line FROM l WHERE (pos <= 3 OR pos > n - 3) AND length(line) <= 120)
 SELECT line, count(*) AS pages FROM e WHERE line <> '' GROUP BY line HAVING count(*) >= 5""")
def boilerplate_lines(spark, sf_dir):
    """Short lines at the edges of at least five documents: running heads and feet."""
    ls = F.split("text", "\n")
    edge = model.table(spark, sf_dir, "documents").select("doc_id", F.size(ls).alias("n"), F.posexplode(ls).alias("pos", "line")).where((F.col("pos") < 3) | (F.col("pos") >= F.col("n") - 3)).where(F.length("line") <= 120)
    return edge.select("doc_id", T.collapse(F.col("line")).alias("line")).where("line <> ''").groupBy("line").agg(F.countDistinct("doc_id").alias("pages")).where("pages >= 5")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS o FROM documents)
 SELECT doc_id, 'p1:paragraph:' || o || ':' || substr(sha256(trim(line)), 1, 10) AS anchor FROM l WHERE trim(line) <> ''""")
def block_anchors(spark, sf_dir):
    l = model.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("o", "line")).where(F.trim("line") != "")
    return l.select("doc_id", F.concat(F.lit("p1:paragraph:"), F.col("o"), F.lit(":"), F.substring(F.sha2(F.trim("line"), 256), 1, 10)).alias("anchor"))


@query(f"WITH {DOCS} SELECT document_id, array_to_string(list_sort(allowed_roles), '|') AS roles, sha256(content) AS checksum, length(content) AS characters FROM docs")
def manifest(spark, sf_dir):
    return model.documents(spark, sf_dir).select("document_id", F.array_join(F.array_sort("allowed_roles"), "|").alias("roles"), F.sha2("content", 256).alias("checksum"), F.length("content").cast("long").alias("characters"))


statement("recent_events", "SELECT event_id, event_type FROM {events} ORDER BY ts DESC, event_id DESC LIMIT 25")
statement("json_props", "SELECT event_type, count(*) AS n, count(get_json_object(props, '$.k')) AS with_k FROM {events} GROUP BY event_type", "SELECT event_type, count(*) AS n, count(json_extract_string(props, '$.k')) AS with_k FROM events GROUP BY event_type")


@query()
def chunk_structured(spark, sf_dir):
    return chunking.chunks(model.documents(spark, sf_dir)).select("chunk_id", "parent_id", "position", "token_count", F.length("content").alias("characters"))


@query()
def chunk_legacy(spark, sf_dir):
    return chunking.legacy_chunks(model.documents(spark, sf_dir)).select("document_id", "position", F.length("content").alias("characters"))


@query()
def chunk_evidence_units(spark, sf_dir):
    return chunking.evidence_units(model.documents(spark, sf_dir)).select("document_id", "ordinal", "tokens")


@query(f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '{TOKEN}') AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, greatest(len(w), 1), 100)) AS start FROM t) SELECT doc_id, start, len(w[start + 1:start + 120]) AS size FROM s WHERE len(w) > 0""")
def token_windows(spark, sf_dir):
    """Windows of 120 tokens at every hundredth."""
    t = model.table(spark, sf_dir, "documents").select("doc_id", T.retrieval_tokens(F.col("text")).alias("w")).where(F.size("w") > 0)
    s = t.select("doc_id", F.size("w").alias("n"), F.explode(F.sequence(F.lit(0), F.size("w") - 1, F.lit(100))).alias("start"))
    return s.select("doc_id", F.col("start").cast("long").alias("start"), F.least(F.lit(120), F.col("n") - F.col("start")).cast("long").alias("size"))


def hashed(docs: DataFrame, dimensions: int = 384) -> DataFrame:
    """doc_id, vector: signed feature hashing (8-byte BLAKE2b, little-endian; place modulo dimensions, sign by the low bit), unit length."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place: dict[str, tuple[int, float]] = {}
        for p in parts:
            out = []
            for tokens in p["tokens"]:
                v = np.zeros(dimensions)
                for t in tokens:
                    if t not in place:
                        if len(place) > 200_000:
                            place.clear()
                        h = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little")
                        place[t] = (h % dimensions, 1.0 if h & 1 else -1.0)
                    k, sign = place[t]
                    v[k] += sign
                n = np.linalg.norm(v)
                out.append((v / n if n else v).astype(np.float32))
            yield pd.DataFrame({"doc_id": p["doc_id"], "vector": out})

    return docs.select("doc_id", T.retrieval_tokens(F.col("text")).alias("tokens")).mapInPandas(work, "doc_id long, vector array<float>")


@query()
def hash_embedding(spark, sf_dir):
    return hashed(model.table(spark, sf_dir, "documents")).select("doc_id", "vector")


# -- knowledge graph: candidates are long tokens of documents; kinds and positions come from their letters and places

CAND = f"""tk AS (SELECT doc_id, regexp_extract_all(lower(text), '{TOKEN}') AS w FROM documents WHERE doc_id < 200), x AS (SELECT doc_id, unnest(w) AS name, generate_subscripts(w, 1) AS pos FROM tk),
 cand AS (SELECT doc_id * 100000 + pos AS candidate_id, doc_id, name, CASE WHEN length(name) % 2 = 0 THEN 'product' ELSE 'version' END AS kind, (50 + (doc_id * 7 + pos * 3) % 50) / 100.0::DOUBLE AS confidence, pos AS start FROM x WHERE length(name) >= 9)"""


def entity_candidates(spark, sf_dir) -> DataFrame:
    w = model.table(spark, sf_dir, "documents").where("doc_id < 200").select("doc_id", F.posexplode(T.retrieval_tokens(F.col("text"))).alias("p", "name")).where(F.length("name") >= 9)
    at = (F.col("p") + 1).cast("long")
    return w.select((F.col("doc_id") * 100000 + at).alias("candidate_id"), "doc_id", "name", F.when(F.length("name") % 2 == 0, "product").otherwise("version").alias("kind"), ((50 + (F.col("doc_id") * 7 + at * 3) % 50) / 100.0).alias("confidence"), at.alias("start"))


@query(f"WITH {CAND} SELECT kind, name AS name_key, arg_max(candidate_id, (confidence, -start, -doc_id)) AS representative, max(confidence) AS confidence, count(*) AS members FROM cand GROUP BY kind, name")
def entity_candidate_groups(spark, sf_dir):
    return knowledge.grouped_candidates(entity_candidates(spark, sf_dir))


@query(f"WITH {CAND} SELECT kind || ':' || name AS node_id, doc_id AS document_id, max(confidence) AS confidence FROM cand GROUP BY ALL")
def mention_dedupe(spark, sf_dir):
    return knowledge.best_mentions(entity_candidates(spark, sf_dir).select(F.concat_ws(":", "kind", "name").alias("node_id"), F.col("doc_id").alias("document_id"), "confidence"))


@query(f"WITH {CAND}, p AS (SELECT kind || ':' || substr(name, 1, 6) AS node_id, name AS alias, confidence, 'd' || doc_id AS attribute, candidate_id AS seq FROM cand), f AS (SELECT node_id, alias, min(seq) AS s FROM p GROUP BY ALL) SELECT node_id, (SELECT array_to_string(list(alias ORDER BY s), ',') FROM f WHERE f.node_id = p.node_id) AS aliases, max(confidence) AS confidence, arg_min(attribute, seq) AS attribute FROM p GROUP BY node_id")
def node_merge(spark, sf_dir):
    p = entity_candidates(spark, sf_dir).select(F.concat(F.col("kind"), F.lit(":"), F.substring("name", 1, 6)).alias("node_id"), F.col("name").alias("alias"), "confidence", F.concat(F.lit("d"), "doc_id").alias("attribute"), F.col("candidate_id").alias("seq"))
    return knowledge.merged_nodes(p).withColumn("aliases", F.array_join("aliases", ","))


@query(f"""WITH {CAND}, v AS (SELECT * FROM cand WHERE kind = 'version'), p AS (SELECT * FROM cand WHERE kind = 'product')
 SELECT v.doc_id, v.candidate_id AS left_id, p.candidate_id AS right_id, abs(v.start - p.start) AS distance FROM v JOIN p ON v.doc_id = p.doc_id AND abs(v.start - p.start) <= 22
 QUALIFY row_number() OVER (PARTITION BY v.doc_id, v.candidate_id ORDER BY abs(v.start - p.start), p.candidate_id) = 1""")
def nearest_within_reach(spark, sf_dir):
    """The nearest product within reach of each version."""
    c = entity_candidates(spark, sf_dir)
    return knowledge.nearest_within(c.where("kind = 'version'").select("doc_id", F.col("candidate_id").alias("left_id"), F.col("start").alias("at")), c.where("kind = 'product'").select("doc_id", F.col("candidate_id").alias("right_id"), F.col("start").alias("at")), 22)


@query("""WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS relation_id, CASE WHEN l_linestatus = 'O' THEN 'fixes' ELSE 'version_of' END AS relation, CASE WHEN l_returnflag = 'A' THEN 'apar' ELSE 'version' END AS source_kind, CASE WHEN l_quantity < 25 THEN 'error' ELSE 'product' END AS target_kind,
   l_partkey % 50 AS source_id, l_suppkey % 50 AS target_id, CAST(l_partkey % 100 AS VARCHAR) AS evidence, CAST(l_suppkey AS VARCHAR) || CAST(l_orderkey AS VARCHAR) AS content FROM lineitem WHERE l_orderkey < 2000),
  j AS (SELECT relation_id, CASE WHEN NOT ((relation = 'fixes' AND source_kind = 'apar' AND target_kind = 'error') OR (relation = 'version_of' AND source_kind = 'version' AND target_kind = 'product')) THEN 'kinds' END AS k, CASE WHEN source_id = target_id THEN 'self' END AS s, CASE WHEN NOT contains(content, evidence) THEN 'evidence' END AS e FROM r)
  SELECT relation_id, concat_ws(',', e, k, s) AS issues FROM j""")
def relation_validation(spark, sf_dir):
    l = model.table(spark, sf_dir, "lineitem").where("l_orderkey < 2000")
    r = l.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("relation_id"), F.when(F.col("l_linestatus") == "O", "fixes").otherwise("version_of").alias("relation"), F.when(F.col("l_returnflag") == "A", "apar").otherwise("version").alias("source_kind"),
        F.when(F.col("l_quantity") < 25, "error").otherwise("product").alias("target_kind"), (F.col("l_partkey") % 50).alias("source_id"), (F.col("l_suppkey") % 50).alias("target_id"), (F.col("l_partkey") % 100).cast("string").alias("evidence"),
        F.concat(F.col("l_suppkey").cast("string"), F.col("l_orderkey").cast("string")).alias("content"))
    rules = spark.createDataFrame([("fixes", "apar", "error"), ("version_of", "version", "product")], "relation string, source_kind string, target_kind string")
    return knowledge.relation_issues(r, F.broadcast(rules))


@query(f"WITH {CAND} SELECT kind, count(*) AS proposed, count(*) FILTER (confidence >= 0.75) AS reviewed, round(count(*) FILTER (confidence >= 0.75) / nullif(count(*), 0)::DOUBLE, 6) AS coverage FROM cand GROUP BY kind")
def knowledge_coverage(spark, sf_dir):
    n, ok = F.count(F.lit(1)), F.count_if(F.col("confidence") >= 0.75)
    return entity_candidates(spark, sf_dir).groupBy("kind").agg(n.alias("proposed"), ok.alias("reviewed"), F.round(F.try_divide(ok, n), 6).alias("coverage"))


@query("""WITH c AS (SELECT doc_id AS key, quality AS version FROM labels UNION ALL SELECT doc_id, toxic FROM labels), k AS (SELECT key, count(DISTINCT version) AS v FROM c GROUP BY key)
 SELECT d.doc_id AS key, CASE WHEN v IS NULL THEN 'miss' WHEN v > 1 THEN 'conflict' ELSE 'hit' END AS outcome FROM documents d LEFT JOIN k ON k.key = d.doc_id""")
def replay_cache(spark, sf_dir):
    """Recorded answers by key: one answer is a hit, none a miss, different ones a conflict."""
    l = model.table(spark, sf_dir, "labels")
    c = l.select(F.col("doc_id").alias("key"), F.col("quality").alias("version")).unionByName(l.select(F.col("doc_id").alias("key"), F.col("toxic").alias("version")))
    k = c.groupBy("key").agg(F.countDistinct("version").alias("v"))
    d = model.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"))
    return d.join(k, "key", "left").select("key", F.when(F.col("v").isNull(), "miss").when(F.col("v") > 1, "conflict").otherwise("hit").alias("outcome"))


# -- answering

@query(r"""WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\r\n|[\n\r\x0b\x0c]')) AS line FROM documents), c AS (SELECT doc_id, trim(regexp_replace(line, '\s+', ' ', 'g')) AS line FROM l),
  u AS (SELECT doc_id, unnest(string_split(regexp_replace(line, '([.!?;。！？；])\s+', '\1' || chr(1), 'g'), chr(1))) AS s FROM c) SELECT doc_id, count(DISTINCT lower(s)) AS units, sum(length(s))::BIGINT AS characters FROM u WHERE s <> '' GROUP BY doc_id""")
def evidence_sentences(spark, sf_dir):
    """Distinct sentences of whole documents, whatever their case."""
    u = model.table(spark, sf_dir, "documents").select("doc_id", F.explode(answering.sentence_units(F.col("text"))).alias("s"))
    return u.groupBy("doc_id").agg(F.countDistinct(F.lower("s")).alias("units"), F.sum(F.length("s")).cast("long").alias("characters"))


STEMS = T.STEM_SUFFIXES
_STEM = "CASE " + " ".join(f"WHEN suffix(term, '{s}') AND length(term) - {len(s)} >= 5 THEN substr(term, 1, length(term) - {len(s)})" for s in STEMS) + " ELSE term END"


@query(f"""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS term FROM benchmark) SELECT term, {_STEM} AS stem, CASE WHEN regexp_matches(term, '[0-9._:/-]') THEN 4 WHEN length(term) >= 6 THEN 2 ELSE 1 END AS weight FROM t""")
def question_terms(spark, sf_dir):
    t = model.gold(spark, sf_dir).select(F.explode(T.retrieval_tokens(F.col("query"))).alias("term")).distinct()
    return t.select("term", T.stem(F.col("term")).alias("stem"), T.term_weight(F.col("term")).alias("weight"))


@query(r"""WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS b FROM documents), p AS (SELECT doc_id, b, list_filter([instr(lower(b), 'idiot'), instr(lower(b), 'that')], lambda x: x > 0) AS ps FROM d),
 s AS (SELECT doc_id, b, greatest(coalesce(list_min(ps) - 1, 0) - 120, 0) AS st0 FROM p), e AS (SELECT *, least(st0 + 360, length(b)) AS en, greatest(least(st0 + 360, length(b)) - 360, 0) AS st FROM s)
 SELECT doc_id, CASE WHEN length(b) <= 360 THEN b ELSE CASE WHEN st > 0 THEN '...' ELSE '' END || substr(b, st + 1, en - st) || CASE WHEN en < length(b) THEN '...' ELSE '' END END AS excerpt FROM e""")
def query_excerpt(spark, sf_dir):
    return model.table(spark, sf_dir, "documents").select("doc_id", T.excerpt(F.array(F.lit("idiot"), F.lit("that")), F.col("text"), 360).alias("excerpt"))


@query("""SELECT * FROM (VALUES (1, '3,1,2,4', 'answer'), (2, '1,2,3', 'text'), (3, '2,1,3,4,5', '')) t(id, ranking, cleaned)""")
def ranking_parse(spark, sf_dir):
    rows = spark.createDataFrame([(1, "[3, 1, 1, 9]", 4, "<think>x</think> answer"), (2, "none", 3, "text<think>open"), (3, "2 > 2 > 1", 5, "<THINK>a\nb</THINK>")], "id int, said string, n int, raw string")
    return rows.select("id", F.array_join(F.transform(T.ranking(F.col("said"), F.col("n")), lambda x: x.cast("string")), ",").alias("ranking"), T.strip_reasoning(F.col("raw")).alias("cleaned"))


@query("""SELECT doc_id, 'product:' || trim(regexp_replace(lower(source || ' ' || lang), '[^a-z0-9]+', '-', 'g'), '-') AS node_id FROM documents""")
def knowledge_ids(spark, sf_dir):
    return model.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("product:"), T.slug(F.concat_ws(" ", "source", "lang"))).alias("node_id"))


@query()
def streaming_daily_counts(spark, sf_dir):
    """The windowed stream run to its end: daily counts of all events, by availableNow."""
    import shutil
    import tempfile
    import uuid

    from corvane.streaming import ledger

    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    own = conf or tempfile.mkdtemp(prefix="corvane-stream-")
    name = f"daily_{uuid.uuid4().hex}"
    stream = spark.readStream.schema(ledger.EVENTS).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    q = ledger.windowed(stream).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{own}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    if not conf:
        shutil.rmtree(own, ignore_errors=True)
    return spark.table(name)
