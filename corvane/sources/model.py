"""The engine's entities as views over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, document_id, title, content, business_class, allowed_roles, status."""
    d, q = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    roles = F.when(F.col("doc_id") % 7 == 0, F.array("lang", F.lit("restricted"))).otherwise(F.array("lang"))
    return d.join(q, "doc_id", "left").select(
        "doc_id", F.concat(F.lit("doc-"), F.col("doc_id")).alias("document_id"), F.substring(F.substring_index("text", "\n", 1), 1, 80).alias("title"),
        F.col("text").alias("content"), F.col("source").alias("business_class"), roles.alias("allowed_roles"),
        F.when(F.col("quality") == 0, "draft").otherwise("active").alias("status"),
    )


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, query: the benchmark passages as questions."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as assertions: user, kind and value, valid from the event's time, recorded zero to two days later."""
    e = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    return e.select(
        F.col("event_id").alias("assertion_id"), F.col("user_id").alias("subject_id"), F.col("event_type").alias("predicate"), F.col("value"),
        ts.alias("valid_from"), (ts + F.make_dt_interval((F.col("event_id") % 3).cast("int"))).alias("recorded_at"),
        ((F.col("event_id") % 10) / 10.0).alias("confidence"), ((F.col("event_id") % 7) / 7.0).alias("importance"),
    )


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, document_id, title, allowed_roles, position, content: the lines of each document as its chunks."""
    at = F.posexplode(F.split("content", "\n")).alias("position", "content")
    return docs.select("doc_id", "document_id", "title", "allowed_roles", at)


def literal_rows(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """A small fixed table."""
    return spark.createDataFrame(rows, columns)


def roles(*names: str) -> Column:
    return F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
