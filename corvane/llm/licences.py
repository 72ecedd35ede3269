"""License scans by an exact set-similarity join.

A text block is a window of consecutive words of the whole text, whatever lines they stand on. A template of n words meets windows of n + ceil(n / 4) words (a shorter text is
one window). A window meets it when it holds at least `threshold` of the template's distinct words - all of them, if these are fewer than `SHORT` - with every
word the template requires (`must`) and none that speaks for another license (`without`). Windows that meet one after the other are one match.

The join is exact and never compares all pairs. The words of the templates are ordered by their frequency in the whole corpus, rarest first
(one pass, a count a word). With a words needed of size:
    prefix filter    a matching window holds one of the template's first size - a + 1 words, so only windows around these words are looked at;
    length filter    a text with fewer than a of the template's words is skipped;
    positional filter  the template's words in a window stand in the order's last size - i places, i being the place of its rarest one: fewer than a can't do;
and in the windows that remain the words are counted in full, one word entering and one leaving at each step.

The templates are a documented, bounded parameter (`MAX_TEMPLATES`), so their index travels to the tasks; texts are never shuffled, grouped or
collected, and a line that half of all documents hold costs each of them the same.

Beside the windows, three base phrases are searched as consecutive words of the whole text.

Nulls: a null text is the empty text, without words and labels; null ids are kept. Repeated rows yield equal rows, an empty table an empty
result; other columns are ignored. A template without words, or with more required words than it has, is an error.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import bounded_batches
from corvane.llm.toxicity import WORD

MAX_TEMPLATES = 1000
#: A template of fewer distinct words must stand in a window whole.
SHORT = 10

#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


class Template(NamedTuple):
    label: str
    text: str
    must: tuple[str, ...] = ()
    without: tuple[str, ...] = ()


_OTHER_CC = ("nc", "nd", "sa", "noncommercial", "noderivatives", "sharealike")
#: Common short notices and the leading sentence of common texts.
TEMPLATES = [
    Template("apache", "Licensed under the Apache License, Version 2.0"),
    Template("mit", "Released under the MIT License"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3", ("gnu", "public"), ("lesser", "affero")),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", ("gnu", "public"), ("lesser", "affero")),
    Template("lgpl", "modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("lesser",)),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    Template("cc-by", "Licensed under CC BY 4.0", (), _OTHER_CC),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("commons", "attribution"), _OTHER_CC),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("sharealike",), _OTHER_CC[:2] + _OTHER_CC[3:5]),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License", ("mozilla",)),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered",)),
    Template("reserved", "All rights reserved"),
]

_UPPER = {c: c + 32 for c in range(65, 91)}
_WORDS = re.compile(WORD)


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").translate(_UPPER))


class Shape(NamedTuple):
    """A template as the search sees it: its distinct words in the global order, how many are needed, and the width of its windows."""

    label: str
    words: tuple[str, ...]
    need: int
    width: int
    must: frozenset[str]
    without: frozenset[str]


def shape(template: Template | tuple, threshold: float, frequency: dict[str, int] | None = None) -> Shape:
    t = Template(*template)
    n, known = words_of(t.text), frequency or {}
    own = tuple(sorted(set(n), key=lambda w: (known.get(w, 0), w)))
    if not own or not set(t.must) <= set(own) or not 0 < threshold <= 1:
        raise ValueError(f"no words, required words that are not its own, or a threshold outside (0, 1]: {t.label}")
    need = len(own) if len(own) < SHORT else math.ceil(threshold * len(own) - 1e-9)
    return Shape(t.label, own, need, len(n) + math.ceil(len(n) / 4), frozenset(t.must), frozenset(t.without) - set(own))


class Index:
    """The templates' prefix index under a global word order."""

    def __init__(self, templates: list[Template], frequency: dict[str, int], threshold: float):
        if len(templates) > MAX_TEMPLATES:
            raise ValueError("too many templates")
        self.shapes = [shape(t, threshold, frequency) for t in templates]
        self.sets = [frozenset(t.words) for t in self.shapes]
        self.rank = [{w: k for k, w in enumerate(t.words)} for t in self.shapes]
        self.prefix: dict[str, list[int]] = {}
        for k, t in enumerate(self.shapes):
            for w in t.words[: len(t.words) - t.need + 1]:
                self.prefix.setdefault(w, []).append(k)

    def matches(self, words: list[str]) -> list[tuple[int, int, int, float]]:
        """(template, first word, last word, containment) of every match in a text."""
        held = set(words)
        met = {k for w in held & self.prefix.keys() for k in self.prefix[w]}
        wanted = [k for k in met if len(held & self.sets[k]) >= self.shapes[k].need and self.shapes[k].must <= held]
        if not wanted:
            return []
        heads = set().union(*(self.shapes[k].words[: len(self.sets[k]) - self.shapes[k].need + 1] for k in wanted))
        places: dict[str, list[int]] = {}
        for p, w in enumerate(words):
            if w in heads:
                places.setdefault(w, []).append(p)
        return [m for k in sorted(wanted) for m in self._windows(k, words, places)]

    def _windows(self, k: int, words: list[str], places: dict[str, list[int]]) -> Iterator[tuple[int, int, int, float]]:
        t, own, last = self.shapes[k], self.sets[k], max(0, len(words) - self.shapes[k].width)
        spots = sorted(p for w in t.words[: len(own) - t.need + 1] for p in places.get(w, ()))
        at = 0
        while at < len(spots):
            # starts of the windows that hold a prefix word, as long as they follow each other
            lo, hi = max(0, spots[at] - t.width + 1), min(spots[at], last)
            while at + 1 < len(spots) and spots[at + 1] - t.width + 1 <= hi + 1:
                at += 1
                hi = min(spots[at], last)
            at += 1
            if lo <= hi:
                yield from self._slide(k, words, lo, hi, own)

    def _slide(self, k: int, words: list[str], lo: int, hi: int, own: frozenset[str]) -> Iterator[tuple[int, int, int, float]]:
        t, rank = self.shapes[k], self.rank[k]
        n = Counter(w for w in words[lo : lo + t.width] if w in own)
        bad = sum(w in t.without for w in words[lo : lo + t.width])
        first, best = -1, 0
        for i in range(lo, hi + 1):
            if i > lo:
                old = words[i - 1]
                if old in own:
                    n[old] -= 1
                    if not n[old]:
                        del n[old]
                bad -= old in t.without
                new = words[i + t.width - 1]
                if new in own:
                    n[new] += 1
                bad += new in t.without
            good = len(n) >= t.need and not bad and t.must <= n.keys() and len(own) - min(map(rank.__getitem__, n)) >= t.need
            if good:
                first, best = (i if first < 0 else first), max(best, len(n))
            if first >= 0 and (not good or i == hi):
                end = i if good else i - 1
                yield k, first, min(end + t.width, len(words)) - 1, best / len(own)
                first, best = -1, 0


def frequencies(docs: DataFrame, vocabulary: set[str], text: str = "text") -> dict[str, int]:
    """Uses of each template word in the whole corpus: a row a word and task is shuffled, one a word collected."""
    bounded_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                n.update([w for w in words_of(t) if w in vocabulary])
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["w", "n"])

    return {r["w"]: r["n"] for r in docs.select(text).mapInArrow(work, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()}


def phrase_places(words: list[str], phrases: dict[str, str] = PHRASES) -> list[tuple[int, str]]:
    """(start, label) of every place where a phrase's words stand one after the other."""
    heads: dict[str, list[tuple[list[str], str]]] = {}
    for p, label in phrases.items():
        heads.setdefault(p.split()[0], []).append((p.split(), label))
    out = []
    for k, w in enumerate(words):
        for p, label in heads.get(w, ()):
            if words[k : k + len(p)] == p:
                out.append((k, label))
    return out


SCAN = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,first_word:long,last_word:long,containment:double>>"


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, templates: list[Template] = TEMPLATES, threshold: float = 0.8, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """Per row: its base phrases, and `matches`, every stretch of windows that meets a template."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    vocabulary = {w for t in templates for w in words_of(Template(*t).text)}
    index = Index(templates, frequencies(rows, vocabulary), threshold)
    heads = {p.split()[0] for p in phrases}
    kind = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("containment", pa.float64())]))
    kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64(), kind]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]

    def one(i: int | None, t: str | None) -> tuple:
        words = words_of(t)
        held = set(words)
        places = phrase_places(words, phrases) if not heads.isdisjoint(held) else []
        found = [{"label": index.shapes[k].label, "first_word": a, "last_word": b, "containment": share} for k, a, b, share in index.matches(words)]
        base = {label for _, label in places}
        score = max([1.0 if places else 0.0, *(f["containment"] for f in found)])
        return (i, len(words), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None), ",".join(sorted(base)), ",".join(sorted(base | {f["label"] for f in found})), score, found)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(zip(*map(one, b.column(0).to_pylist(), b.column(1).to_pylist()))) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return rows.mapInArrow(work, SCAN)
