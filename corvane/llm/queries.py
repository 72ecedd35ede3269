"""The registered queries of this subpackage: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import lattice_lm, licences, line_align, merge_dropout, mixing, ogg, onebit_ann, pseudonyms, simhash, toxicity
from corvane.llm.common import fold_of, table

#: Where the public vocabulary lies on every machine.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


#: A key for tests and checks; a deployment passes its own.
PSEUDONYM_KEY = "corvane-pseudonyms-1"


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymize(docs, PSEUDONYM_KEY).select("doc_id", "text", "n_values", "kinds")


def op2_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"), threshold=0.8).withColumn("n_matches", F.size("matches").cast("long")).drop("matches")


def op3_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(fold_of(F.col("doc_id"), 7) == 2, F.lit(False)).alias("held_out"))
    return lattice_lm.score(docs, PIECE_MODEL, em_steps=1)


def op4_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "laps")


def op5_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=2, words=3, seed=42)
    return found.select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")


def op6_line_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_align.dedup_lines(docs).select("doc_id", "text", "lines_dropped", "words_dropped")


def op7_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(fold_of(F.col("doc_id"), 5) == 0, F.lit(False))
    known = table(spark, sf_dir, "labels").where(~held)
    scored = toxicity.with_scores(docs, toxicity.fit(toxicity.labelled_rows(docs, known)), "score")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    merger = merge_dropout.Merger(PIECE_MODEL, dropout=0.1, seed=8)
    return merge_dropout.encode(docs, merger, "ids", verified="lossless").select("doc_id", F.size("ids").alias("n_ids"), "ids", "lossless")


def op9_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_digest(ogg.probe(ogg.to_media(table(spark, sf_dir, "documents"))))


def op10_onebit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return onebit_ann.search(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_feistel_pseudonyms": op1_feistel_pseudonyms,
    "op2_license_join": op2_license_join,
    "op3_lattice_lm": op3_lattice_lm,
    "op4_sainte_lague_mix": op4_sainte_lague_mix,
    "op5_covering_simhash": op5_covering_simhash,
    "op6_line_alignment": op6_line_alignment,
    "op7_kneser_ney_toxicity": op7_kneser_ney_toxicity,
    "op8_merge_dropout": op8_merge_dropout,
    "op9_ogg_media": op9_ogg_media,
    "op10_onebit_neighbours": op10_onebit_neighbours,
}

def _license_sql() -> str:
    """The same containment and phrases in SQL: every window of the whole text against every template."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    listed = lambda ws: f"[{', '.join(repr(w) for w in sorted(ws))}]::VARCHAR[]"
    shapes = [licences.shape(t, 0.8) for t in licences.TEMPLATES]
    rows = [f"({k}, '{t.label}', {listed(t.words)}, {t.need}, {t.width}, {listed(t.must)}, {listed(t.without)})" for k, t in enumerate(shapes)]
    places = []
    for phrase, label in licences.PHRASES.items():
        test = " AND ".join(f"w[i + {n}] = '{w}'" for n, w in enumerate(phrase.split(), 1))
        places.append(f"SELECT doc_id, rn, unnest(list_filter(range(0, len(w)), lambda i: {test})) AS p, '{label}' AS label FROM w")
    return f"""WITH d AS (SELECT doc_id, row_number() OVER () AS rn, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS t FROM documents), w AS MATERIALIZED (SELECT doc_id, rn, regexp_extract_all(t, '{word}') AS w FROM d),
 pl AS ({' UNION ALL '.join(places)}), base AS (SELECT rn, count(*) AS n, min(p) AS first, max(p) AS last, list(DISTINCT label) AS ls FROM pl GROUP BY rn),
 te(k, label, tw, need, width, must, without) AS (VALUES {', '.join(rows)}), held AS (SELECT rn, w, list_distinct(w) AS h FROM w),
 cand AS MATERIALIZED (SELECT rn, k, w, label, tw, need, width, must, without FROM held, te WHERE len(list_intersect(h, tw)) >= need AND list_has_all(h, must)),
 st AS (SELECT rn, k, label, tw, need, must, without, i, w[i + 1:i + width] AS b FROM (SELECT *, unnest(range(0, greatest(0, len(w) - width) + 1)) AS i FROM cand)),
 hit AS (SELECT rn, k, i, label, len(list_intersect(list_distinct(b), tw))::DOUBLE / len(tw) AS share FROM st WHERE len(list_intersect(list_distinct(b), tw)) >= need AND list_has_all(b, must) AND NOT list_has_any(b, without)),
 run AS (SELECT *, coalesce(lag(i) OVER (PARTITION BY rn, k ORDER BY i) <> i - 1, true) AS new FROM hit),
 met AS (SELECT rn, count(*) FILTER (new) AS n, max(share) AS share, list(DISTINCT label) AS ls FROM run GROUP BY rn)
 SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(base.n, 0) AS n_base, base.first AS first_word, base.last AS last_word, coalesce(array_to_string(list_sort(base.ls), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.ls, []), coalesce(met.ls, [])))), ',') AS labels, greatest(CASE WHEN base.n > 0 THEN 1.0 ELSE 0.0 END, coalesce(met.share, 0.0))::DOUBLE AS score, coalesce(met.n, 0) AS n_matches
 FROM w LEFT JOIN base USING (rn) LEFT JOIN met USING (rn)"""


#: Water filling, highest quotients for sources and shards, and the seeded run of blocks.
_MIX_SQL = r"""WITH sz AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(concat_ws('|', 7, doc_id, text)) AS spot FROM documents),
 tot AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM sz GROUP BY source),
 w AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM tot),
 l AS (SELECT *, cap / weight AS ratio, (total - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY cap / weight, source IS NULL, source)),
 t AS (SELECT source, source_size, n, least(cap, coalesce(weight * (SELECT max(level) FROM l WHERE ratio > level), cap)) AS target FROM l), m AS (SELECT round(sum(target) / 16)::BIGINT AS seats, count(*) AS parties FROM t),
 q AS (SELECT source, target / (2 * k + 1) AS quot, k FROM (SELECT source, target, unnest(range(0, ceil(target / 16)::BIGINT + parties + 2)) AS k FROM t, m WHERE target > 0)),
 won AS (SELECT source, count(*) AS quota FROM (SELECT source, row_number() OVER (ORDER BY quot DESC, source IS NULL, source, k) AS r FROM q), m WHERE r <= seats GROUP BY source),
 g AS (SELECT t.*, coalesce(quota, 0) AS quota, least(65536, greatest(1, ceil(source_size / 131072.0), ceil(n / 4096.0)))::BIGINT AS shards FROM t LEFT JOIN won ON t.source IS NOT DISTINCT FROM won.source),
 d AS (SELECT sz.*, source_size, target, quota, shards, ('0x' || substr(spot, 1, 8))::BIGINT % shards AS shard FROM sz JOIN g ON sz.source IS NOT DISTINCT FROM g.source),
 sh AS (SELECT source, shard, sum(size)::BIGINT AS shard_size, max(quota) AS seats, max(source_size) AS source_size, max(shards) AS shards FROM d GROUP BY source, shard),
 sq AS (SELECT source, shard, seats, shard_size / (2 * k + 1)::DOUBLE AS quot, k FROM (SELECT *, unnest(range(0, ceil(seats * shard_size / source_size::DOUBLE)::BIGINT + shards + 2)) AS k FROM sh WHERE shard_size > 0)),
 sw AS (SELECT source, shard, count(*) AS blocks FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY quot DESC, shard, k) AS r FROM sq) WHERE r <= seats GROUP BY source, shard),
 p AS (SELECT d.*, shard_size, least(coalesce(blocks, 0) * 16, shard_size * 2) AS words, sum(size) OVER (PARTITION BY d.source, d.shard ORDER BY spot, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start,
  ('0x' || substr(md5(concat_ws('|', 8, d.source, d.shard)), 1, 8))::BIGINT % greatest(1, ceil(shard_size / 16.0)::BIGINT) * 16 AS at_
  FROM d JOIN sh ON d.source IS NOT DISTINCT FROM sh.source AND d.shard = sh.shard LEFT JOIN sw ON d.source IS NOT DISTINCT FROM sw.source AND d.shard = sw.shard),
 f AS (SELECT *, CASE WHEN shard_size > 0 THEN words // shard_size ELSE 0 END AS laps, CASE WHEN shard_size > 0 THEN at_ + words - words // shard_size * shard_size ELSE 0 END AS stop FROM p),
 h AS (SELECT *, least(size, greatest(0, at_ - start)) AS first FROM f)
 SELECT doc_id, size, source_size, target, (laps * size + least(size, greatest(first, stop - start)) - first + least(size, greatest(0, stop - shard_size - start)))::BIGINT AS taken, laps::BIGINT AS laps FROM h"""

ORACLE_SQL: dict[str, str] = {
    "op4_sainte_lague_mix": _MIX_SQL,
    "op2_license_join": _license_sql(),
    "op10_onebit_neighbours": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 q AS (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 100 = 0),
 d AS (SELECT q.vec_id AS query_id, q.v AS qv, r.vec_id, sqrt(list_reduce(list_transform(list_zip(q.v, r.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, b: a + b)) AS score FROM q JOIN v r ON q.vec_id <> r.vec_id AND len(q.v) = len(r.v))
 SELECT query_id, row_number() OVER (PARTITION BY query_id, qv ORDER BY score, vec_id)::INTEGER AS rank, vec_id, score FROM d QUALIFY rank <= 10""",
}
