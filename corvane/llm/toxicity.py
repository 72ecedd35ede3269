"""Toxicity by two class-conditional models that share their backoff counts.

A text's evidence is the difference of its log-likelihoods under a model of toxic and one of ordinary texts, divided by its number of words.

Kneser-Ney's frame is kept: counts are type counts (an expression counts once a distinct text, so neither bursts nor copies inflate it), each level is
discounted and interpolated with the level below, and both classes back off to the same counts. Its fixed discount is not. With an absolute discount below one per count, the
two models differ a little in every common word - by chance, and because languages and sources are unevenly toxic - and over a long text these differences outweigh a few rude
words: plain interpolated Kneser-Ney bigrams found 40 of 97 held-out toxic texts at 126 false alarms (README). So here the discount grows with the count expected from the
shared level: `z` standard deviations of it, and at least the fraction that absolute discounting takes. A count that lies no further from its expectation gives
all its mass to the shared backoff; rare or evenly used expressions then have the same probability under both models and say nothing, and the difference needs only the
expressions that remain:
    unigrams  log P(w | toxic) - log P(w | ordinary), expected from shared counts of both classes;
    bigrams   what the pair adds to that, expected from its second word.
These tables hold a few thousand entries, whatever the corpus, because they come from at most `max_rows` labelled rows (smallest keyed hash of
the id first, then the smaller id).

Three quarters of those rows give the counts, one quarter fixes the threshold (the best F1 there) and so the score
1 / (1 + (threshold / evidence)^4), which is 0.5 at the threshold and grows with the evidence.

Nulls: a null or empty text has no evidence and a score below 0.5; null labels and null ids teach nothing; a row without label is scored all the same.
Several labels of one id: toxic if any is. With no toxic or no ordinary training text every score is 0. Repeated rows
yield repeated result rows; an empty table an empty result. Columns of the name of the output are replaced, others pass through.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import bounded_batches, materialize, plus

#: Words: ASCII letters and digits and all other characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = {c: c + 32 for c in range(65, 91)}
POWER = 4


@dataclass
class Model:
    """Evidence of words and of pairs, and the evidence per word from which a text counts as toxic."""

    words: dict[str, float] = field(default_factory=dict)
    pairs: dict[tuple[str, str], float] = field(default_factory=dict)
    threshold: float = math.inf
    _second: set[str] | None = None

    def evidence(self, text: str | None) -> float:
        tokens = re.findall(WORD, (text or "").translate(_UPPER))
        if not tokens:
            return 0.0
        get = self.words.get
        total = sum([get(w, 0.0) for w in tokens])
        if self.pairs:
            if self._second is None:
                self._second = {w for _, w in self.pairs}
            second, pair = self._second, self.pairs.get
            total += sum([pair((tokens[i - 1], w), 0.0) for i, w in enumerate(tokens) if w in second and i])
        return total / len(tokens)

    def score(self, evidence: float) -> float:
        if evidence <= 0 or math.isinf(self.threshold):
            return 0.0
        return 1.0 / (1.0 + (self.threshold / evidence) ** POWER)


def _level(n: Column, expected: Column, z: float, least: float) -> Column:
    """The count after discounting towards its expectation."""
    away = n - expected
    room = F.greatest(F.lit(least), F.lit(z) * F.sqrt(expected + 0.25))
    return F.when(F.abs(away) <= room, expected).otherwise(n - F.signum(away) * room)


def _evidence(e1: Column, e0: Column, z: float, least: float = 0.75) -> Column:
    half = F.lit(0.5)
    return F.log((_level(F.col("n1"), e1, z, least) + half) / (e1 + half)) - F.log((_level(F.col("n0"), e0, z, least) + half) / (e0 + half))


def words_of(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def fit(labelled: DataFrame, *, max_rows: int = 40_000, z: float = 3.5, z_pairs: float = 5.0, seed: int = 11) -> Model:
    """Learn from rows (doc_id, text, toxic); at most `max_rows` of them, one of each distinct text."""
    rows = labelled.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", (F.col("toxic") > 0).cast("int").alias("y"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.withColumn("k", F.xxhash64(F.lit(seed), "doc_id"))
    chosen = keyed.select("k", "doc_id").orderBy("k", "doc_id").limit(max_rows).select("doc_id").distinct()
    sample = keyed.join(chosen, "doc_id").withColumn("h", F.xxhash64("text"))
    first = sample.groupBy("h").agg(F.min_by("doc_id", F.struct("k", "doc_id")).alias("doc_id"))
    sample = materialize(sample.join(first, ["h", "doc_id"]).groupBy("doc_id", "k", "h").agg(F.max("y").alias("y"), F.first("text").alias("text")), "toxicity-sample")
    taught = sample.where(F.pmod(F.col("k"), F.lit(4)) != 0).select("y", words_of(F.col("text")).alias("w"))

    def counts(items: DataFrame, *by: str) -> DataFrame:
        return items.groupBy(*by).agg(F.sum("y").cast("double").alias("n1"), F.sum(1 - F.col("y")).cast("double").alias("n0"))

    words = materialize(counts(taught.select("y", F.explode(F.array_distinct("w")).alias("w")), "w"), "toxicity-words")
    t1, t0 = words.agg(F.sum("n1"), F.sum("n0")).first()
    if not t1 or not t0:
        return Model()
    both = F.col("n1") + F.col("n0")
    l1 = words.withColumn("l", _evidence(both * F.lit(t1 / (t1 + t0)), both * F.lit(t0 / (t1 + t0)), z)).where("l <> 0").select("w", "l")
    model = Model({r["w"]: r["l"] for r in l1.collect()})

    # a pair is one string (words hold no blanks): distinct strings are found by hashing, distinct structs by comparing all
    couples = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.get("w", i - 1), F.get("w", i))))
    both_words = F.split("p", " ")
    # a discount is z_pairs / 2 at least, so rarer pairs lie within it whatever their classes
    pairs = counts(taught.where(F.size("w") > 1).select("y", F.explode(couples).alias("p")), "p").where(both > z_pairs / 2).select("n1", "n0", both_words[0].alias("h"), both_words[1].alias("w"))
    ratio = F.exp(F.coalesce("l", F.lit(0.0))) * F.lit(t1 / t0)
    seen = pairs.join(l1, "w", "left").withColumn("e1", both * ratio / (1 + ratio))
    l2 = seen.withColumn("g", _evidence(F.col("e1"), both - F.col("e1"), z_pairs)).where("g <> 0").select("h", "w", "g")
    model.pairs = {(r["h"], r["w"]): r["g"] for r in l2.collect()}

    # at most about a quarter of `max_rows` pairs of numbers
    checked = sorted(with_evidence(sample.where(F.pmod(F.col("k"), F.lit(4)) == 0), model, "e").select("e", "y").collect(), key=lambda r: -r["e"])
    total, best, right = sum(r["y"] for r in checked), 0.0, 0
    for k, r in enumerate(checked):
        if r["e"] <= 0:
            break
        right += r["y"]
        f1 = 2 * right / (k + 1 + total)
        if (k + 1 == len(checked) or checked[k + 1]["e"] < r["e"]) and f1 > best:
            below = max(checked[k + 1]["e"], 0.0) if k + 1 < len(checked) else 0.0
            best, model.threshold = f1, (r["e"] + below) / 2
    if math.isinf(model.threshold) and model.words:
        model.threshold = max(model.words.values()) / 100  # no labelled row to check against: one strong word in a hundred
    return model


def with_evidence(docs: DataFrame, model: Model, out: str, text: str = "text") -> DataFrame:
    """All columns of `docs` and the evidence per word in `out`."""
    bounded_batches(docs.sparkSession)
    rest = docs.drop(out) if out in docs.columns else docs

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.evidence(t) for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.float64())], [*b.schema.names, out])

    return rest.mapInArrow(add, plus(rest, **{out: "double"}))


def with_scores(docs: DataFrame, model: Model, out: str = "score", text: str = "text") -> DataFrame:
    """All columns of `docs` and the score (0 to 1; at 0.5 or more: toxic) in `out`."""
    e = F.col(out)
    limit = float(model.threshold)
    score = F.lit(0.0) if math.isinf(limit) else F.when(e <= 0, F.lit(0.0)).otherwise(1.0 / (1.0 + F.pow(F.lit(limit) / e, F.lit(float(POWER)))))
    return with_evidence(docs, model, out, text).withColumn(out, score)


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of the documents with a label; an id with several labels is toxic if any says so."""
    known = labels.where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return docs.select("doc_id", "text").join(known, "doc_id")
