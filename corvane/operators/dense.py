"""Exact vector scoring inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.lexical import top


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def scored(rows: DataFrame, queries: DataFrame, digits: int = 6) -> DataFrame:
    """query_id, vec_id, score = max(dot, 0). Every query meets every row, the stated meaning of exact search: Spark
    broadcasts a batch of queries that is small by its measured size, and pairs partitions otherwise."""
    return rows.join(queries, F.lit(True)).select("query_id", "vec_id", F.round(F.greatest(F.lit(0.0), dot(F.col("v"), F.col("q"))), digits).alias("score"))


def nearest(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact top k by inner product, the query's own row left out; ties by id."""
    return top(scored(rows, queries).where("query_id <> vec_id"), k, "score", "vec_id")
