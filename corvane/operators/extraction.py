"""Rule-based extraction: sections, entities, relations, events, review units."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions import workers
from corvane.operators import knowledge
from corvane.sources import durable

#: Section titles of technical notes.
TITLES = ["ABSTRACT", "ANSWER", "CAUSE", "CONTENT", "DESCRIPTION", "ENVIRONMENT", "ERROR DESCRIPTION", "LOCAL FIX", "PROBLEM", "PROBLEM CONCLUSION", "QUESTION", "RELATED INFORMATION", "RESOLVING THE PROBLEM", "SOLUTION", "SUMMARY", "SYMPTOM"]

#: Families of rule entities: kind, pattern, confidence.
FAMILIES = [
    ("document", r"(?i)\bswg\w+\b", 1.0),
    ("version", r"(?<![A-Za-z0-9.])[vV]?\d+\.\d+(?:\.\d+)*(?![A-Za-z0-9])", 0.9),
    ("error", r"\b[A-Z]{2,12}\d{3,8}[A-Z]?\b", 0.95),
    ("error", r"\bMQRC(?:_[A-Z0-9]+)+\b", 0.98),
    ("error", r"\b[A-Z][A-Za-z0-9]*(?:Exception|Error)\b", 0.92),
    ("ticket", r"\b[A-Z]{2,12}-\d{2,10}\b", 0.85),
    *[("product", p, 0.96) for patterns in T.PRODUCTS.values() for p in patterns],
    *[("component", p, 0.88) for patterns in T.COMPONENTS.values() for p in patterns],
]


#: Characters that patterns without case take for plain letters, though their lower case is another.
ODD_CASES = {0x130: "i", 0x131: "i", 0x17F: "s", 0x212A: "k"}


def heading(line: Column) -> Column:
    """Whether a line is a section heading: Markdown, numbered, a known title, or nearly all capitals."""
    s = F.trim(line)
    letters, capitals = F.length(F.regexp_replace(s, "[^A-Za-z]", "")), F.length(F.regexp_replace(s, "[^A-Z]", ""))
    return (
        s.rlike(r"^#{1,6}\s+\S") | (s.rlike(r"^\d+(\.\d+){0,5}[.)]\s+\S") & (F.length(s) <= 160)) | F.upper(F.regexp_replace(s, ":$", "")).isin(TITLES)
        | ((letters >= 3) & (F.length(s) <= 80) & (capitals >= letters * 0.9) & ~s.rlike(r"[.!?;]$"))
    )


def sections(docs: DataFrame, key: str = "document_id", text: str = "content") -> DataFrame:
    """key, ordinal, title, body, start: runs of lines under their headings; text before the first heading is section 0."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    own = W.partitionBy(key).orderBy("pos")
    marked = lines.withColumn("_h", heading(F.col("line"))).withColumn("ordinal", F.sum(F.col("_h").cast("int")).over(own)).withColumn("_end", F.sum(F.length("line") + 1).over(own))
    parts = marked.groupBy(key, "ordinal").agg(
        F.max(F.when(F.col("_h"), F.regexp_replace(F.trim("line"), r"^#{1,6}\s+|:$", ""))).alias("title"), F.min(F.col("_end") - F.length("line") - 1).alias("start"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("_h"), F.struct("pos", "line")))), lambda x: x["line"]), "\n").alias("body"))
    return parts.where("title IS NOT NULL OR trim(body) <> ''").select(key, "ordinal", F.coalesce("title", F.lit("")).alias("title"), "body", F.col("start").cast("long").alias("start"))


def entities(docs: DataFrame, key: str = "document_id", text: str = "content", before: int = 90, after: int = 120) -> DataFrame:
    """key, kind, name, start, end, confidence, evidence: spans of all families, the first family's where one place has several."""
    compiled = [(k, T.needed(p), re.compile(p), c) for k, p, c in FAMILIES]

    def make(i: str, t: str | None) -> Iterator[tuple]:
        t = t or ""
        low, seen = (t if t.isascii() else t.translate(ODD_CASES)).lower(), set()
        for kind, needed, pattern, confidence in compiled:
            if needed not in low:
                continue
            for m in pattern.finditer(t):
                mark = (kind, m[0].lower(), m.start())
                if mark not in seen:
                    seen.add(mark)
                    yield i, kind, m[0], m.start(), m.end(), confidence, t[max(0, m.start() - before) : m.end() + after]

    out = workers.flat_map(docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")), make, "key string, kind string, name string, start int, end int, confidence double, evidence string")
    return out.withColumnRenamed("key", key)


def relations(found: DataFrame, key: str = "document_id", reach: int = 220) -> DataFrame:
    """key, source, target, relation: versions of the nearest product within reach, and references from the text to the documents it names; each once."""
    # read five times below, found once
    ids = durable.written(found.where(F.col("kind").isin("version", "product", "document")).select(key, "kind", "name", "start", F.xxhash64(key, "kind", "start").alias("_i")), "entities")
    side = lambda kind, name: ids.where(F.col("kind") == kind).select(F.col(key).alias("doc_id"), F.col("_i").alias(name), F.col("start").alias("at"))
    near = knowledge.nearest_within(side("version", "left_id"), side("product", "right_id"), reach)
    names = ids.select(F.col("_i"), F.lower("name").alias("n"))
    ver = near.join(names.withColumnsRenamed({"_i": "left_id", "n": "source"}), "left_id").join(names.withColumnsRenamed({"_i": "right_id", "n": "target"}), "right_id").select(F.col("doc_id").alias(key), "source", "target", F.lit("version_of").alias("relation"))
    ref = ids.where("kind = 'document'").select(key, F.lower(F.col(key)).alias("source"), F.lower("name").alias("target"), F.lit("references").alias("relation"))
    return ver.unionByName(ref).where("source <> target").distinct()


def events(docs: DataFrame, key: str = "document_id", text: str = "content", most: int = 16) -> DataFrame:
    """key, event, entities: the first sentence (the first 320 characters where it is shorter than 32), at most 600; tokens of it, at most `most`."""
    flat = T.collapse(F.col(text))
    first = F.regexp_extract(flat, r"^(.*?[.!?])( |$)", 1)
    event = F.substring(F.when(F.length(first) >= 32, first).otherwise(F.substring(flat, 1, 320)), 1, 600)
    names = F.slice(F.filter(F.array_distinct(T.retrieval_tokens(event)), lambda t: (F.length(t) > 2) & ~t.isin(T.QUERY_STOPWORDS)), 1, most)
    return docs.select(key, event.alias("event"), names.alias("entities"))


def review_units(parts: DataFrame, key: str = "document_id", most: int = 14_000, overlap: int = 500) -> DataFrame:
    """key, unit, text: sections (ordinal, body) of a document packed in order up to `most` characters; longer ones cut to overlapping windows."""

    def pack(i, parts: list[dict]) -> Iterator[tuple]:
        unit, held = 0, ""
        for x in sorted(parts, key=lambda x: x["ordinal"]):
            body = x["body"]
            pieces = [body] if len(body) <= most else [body[k : k + most] for k in range(0, len(body) - overlap, most - overlap)]
            for p in pieces:
                if held and len(held) + 1 + len(p) > most:
                    yield i, unit, held
                    unit, held = unit + 1, ""
                held = f"{held}\n{p}" if held else p
        if held:
            yield i, unit, held

    kind = dict(parts.dtypes)[key]
    whole = parts.groupBy(key).agg(F.collect_list(F.struct("ordinal", "body")).alias("parts"))
    return workers.flat_map(whole, pack, f"{key} {kind}, unit int, text string")


def utc(text: Column, fallback: Column) -> Column:
    """Time stamps as text to timestamps: Z or an offset counts, none means UTC, blank or unreadable gives the fallback."""
    s = F.trim(text)
    return F.coalesce(F.when(s != "", F.try_to_timestamp(F.regexp_replace(s, "[zZ]$", "+00:00"))), fallback)


def json_of(text: Column) -> Column:
    """The JSON object in a model's reply, code fences and talk about it left out, as a variant; null where there is none."""
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.try_parse_json(F.when(inner != "", inner))


def safe_name(name: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.trim(name), r"[^A-Za-z0-9_.-]+", "-"), r"^[-.]+|[-.]+$", ""), 1, 128)
