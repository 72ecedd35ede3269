"""Registration of named queries with the DuckDB SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The documents view in DuckDB.
DOCS = """docs AS (SELECT d.doc_id, 'doc-' || d.doc_id AS document_id, substr(split_part(d.text, chr(10), 1), 1, 80) AS title, d.text AS content,
  d.source AS business_class, CASE WHEN d.doc_id % 7 = 0 THEN [d.lang, 'restricted'] ELSE [d.lang] END AS allowed_roles,
  CASE WHEN l.quality = 0 THEN 'draft' ELSE 'active' END AS status FROM documents d LEFT JOIN labels l USING (doc_id))"""
AUTH = DOCS + """, auth AS (SELECT * FROM docs WHERE status = 'active' AND list_has_any(allowed_roles, ['en', 'fr']))"""
TOKEN = r"[a-z0-9_-]+|[\x{4e00}-\x{9fff}]"
ASSERTIONS = """asr AS (SELECT event_id AS assertion_id, user_id AS subject_id, event_type AS predicate, value, CAST(ts AS TIMESTAMP) AS valid_from,
  CAST(ts AS TIMESTAMP) + to_days(CAST(event_id % 3 AS INTEGER)) AS recorded_at, (event_id % 10) / 10.0::DOUBLE AS confidence, (event_id % 7) / 7.0::DOUBLE AS importance FROM events)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def statement(name: str, sql: str, duckdb: str | None = None) -> None:
    """Register one SQL text for both engines; {table} stands for a table."""
    tables = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables if "{" + t + "}" in sql}
        return spark.sql(sql, **used)

    run.__name__ = name
    QUERIES[name] = run
    text = duckdb or sql
    for t in tables:
        text = text.replace("{" + t + "}", t)
    ORACLE_SQL[name] = text
