"""A corpus pipeline of the training-data operators: toxicity, line dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the folder all executors share and read again as the
next one's docs. All but the last return the columns of `documents`; further columns of the input pass through as far as the operators let them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm import line_align, merge_dropout, mixing, simhash, toxicity
from corvane.llm.common import materialize, table
from corvane.llm.queries import PIECE_MODEL

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 stay, by models of the labelled ones among `docs`. Null and empty texts have no evidence and stay; repeated rows fare alike."""
    model = toxicity.fit(toxicity.labelled_rows(docs, table(spark, sf_dir, "labels")))
    return toxicity.with_scores(docs, model, "__cv_toxic").where(F.col("__cv_toxic") < 0.5).drop("__cv_toxic")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; aligned blocks that an earlier one holds are cut from its text. Null texts and documents without an id stay as they are."""
    cut = line_align.dedup_lines(docs.withColumn("__cv_was", F.col("n_chars")))
    changed = F.when(F.col("lines_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("__cv_was"))
    return cut.withColumn("n_chars", changed).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the texts linked by a Jaccard similarity of their five-word shingles of at least 0.8, the first row by id and text hash stays, once.

    Texts of one id are told apart, null ids come last, null texts count as empty ones. Rows of one id and one text are one document, of which one row stays (by the hash of its other columns).
    """
    groups = simhash.near_copies(docs, least=0.8, words=5)
    keep = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("key") == F.col("first_key"))).select(F.col("doc_id").alias("__cv_id"), F.col("key").alias("__cv_key")).distinct()
    rows = docs.withColumn("__cv_at", F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = rows.join(keep, (F.col("__cv_at") == F.col("__cv_key")) & F.col("doc_id").eqNullSafe(F.col("__cv_id")))
    one = F.struct(*docs.columns)
    return kept.groupBy("__cv_id", "__cv_key").agg(F.min_by(one, F.xxhash64(*docs.columns)).alias("r")).select("r.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: a row for each time a text is taken whole, and one for the part of it that a run of blocks takes besides.

    Null and empty texts have nothing to take. Rows of one id and one text lie side by side in the mix; each takes the part of one of them, in the order of their other columns' hash.
    """
    seed = 7
    plan = mixing.mix(docs.select("doc_id", "text", "source"), seed=seed)
    same = W.partitionBy("doc_id", "spot")
    plan = plan.withColumn("nth", F.row_number().over(same.orderBy("start"))).where("taken > 0")
    plan = materialize(plan.select(F.col("doc_id").alias("__cv_id"), F.col("spot").alias("__cv_spot"), F.col("nth").alias("__cv_n"), *[F.col(c).alias(f"__cv_{c}") for c in ("laps", "size", "first", "last", "wrap")]), "pipeline-mix")
    rows = docs.withColumn("__cv_at", mixing.spot_of(seed, F.col("doc_id"), F.col("text"))).withColumn("__cv_row", F.xxhash64(*docs.columns))
    rows = rows.withColumn("__cv_nth", F.row_number().over(W.partitionBy("doc_id", "__cv_at").orderBy("__cv_row")))
    met = rows.join(plan, F.col("doc_id").eqNullSafe(F.col("__cv_id")) & (F.col("__cv_at") == F.col("__cv_spot")) & (F.col("__cv_nth") == F.col("__cv_n")))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    part = lambda a, b: F.when(b > a, F.when((a == 0) & (b == F.col("__cv_size")), F.col("text")).otherwise(F.array_join(F.slice(words, (a + 1).cast("int"), (b - a).cast("int")), "")))
    pieces = F.concat(F.array_repeat("text", F.col("__cv_laps").cast("int")), F.array(part(F.lit(0), F.col("__cv_wrap")), part(F.col("__cv_first"), F.col("__cv_last"))))
    out = met.withColumn("__cv_piece", F.explode(F.filter(pieces, lambda x: x.isNotNull())))
    length = F.when(F.col("__cv_piece") == F.col("text"), F.col("n_chars")).otherwise(F.length("__cv_piece").cast("long"))
    return out.select(*[(F.col("__cv_piece").alias(c) if c == "text" else length.alias(c) if c == "n_chars" else F.col(c)) for c in docs.columns])


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_ids, ids, lossless): piece ids with merge-dropout, and whether they decode to the very text (the empty one for a null). Repeated rows give equal rows."""
    merger = merge_dropout.Merger(PIECE_MODEL, dropout=0.1, seed=8)
    coded = merge_dropout.encode(docs.select("doc_id", "text", "lang", "source"), merger, "ids", verified="lossless")
    return coded.select("doc_id", "lang", "source", F.size("ids").alias("n_ids"), "ids", "lossless")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", keep_one_of_each_group),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: Several stages (hash fingerprints, learnt models, merges) are beyond SQL; tests hold run() against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole `documents` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.lower().replace(" ", "-"))
    return docs
