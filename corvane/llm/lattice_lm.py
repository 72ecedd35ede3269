"""Language-model scoring by the subword lattice likelihood.

A word's probability is the sum over all its segmentations into pieces of an existing vocabulary, each the product of the pieces' unigram
probabilities: the forward recursion over the lattice, in log space. Pieces start with the space mark or hold none, so a text's lattice falls apart
into its words' and the text's log probability is the sum over its words and one end.

Weights start from the vocabulary's own scores. The public vocabulary's scores are merge ranks, read as a rank-frequency law
(weight 1/(rank+2)); `em_steps` expectation-maximisation steps over the training words' counts then re-estimate them
(expected piece counts from the forward-backward recursion, one pseudo-count shared by the initial weights).
Characters without a piece are spelt with the vocabulary's byte pieces, so every text has a probability.

Dataflow: a task's texts are put together to blocks, each with a list of its distinct words and, apart, one row of who uses which how often. Only blocks'
distinct words are shuffled: once to sum the training counts, once to fetch each word's count and probability, once back to the block. A word that
every text holds is one row a block, so no key is hot. A block is a run of rows of one input partition,
written once with its number to the shared folder. Vocabulary and counts stay distributed; only the piece weights (as many as the vocabulary
has pieces) reach driver and workers.

Nulls: a null text is the empty text (one end); a null id is in no fold, so it trains. Repeated rows are scored and counted
each; an empty table gives an empty result; other columns are ignored. With no training rows all counts are zero, N is 0, and the piece weights are the initial ones.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import BATCH_ROWS, bounded_batches, materialize

#: The end of a text, as a token no word can equal.
END = "\n"
MARK = "▁"
BLOCK_CHARS = 5_000_000


class Lattice:
    """Unigram piece weights (natural log) over an existing vocabulary."""

    def __init__(self, logp: dict[str, float], byte_logp: list[float], end_logp: float):
        self.logp, self.byte_logp, self.end_logp = logp, byte_logp, end_logp
        # pieces with their (negative) log weight, and 0 for what only begins pieces
        self.begins = {p[:k]: 0.0 for p in logp for k in range(1, len(p))} | logp

    @classmethod
    def load(cls, model_file: str) -> Lattice:
        """From a SentencePiece model file: ordinary pieces by rank, byte pieces and the end with small equal shares."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        w: dict[str, float] = {}
        for i in range(m.get_piece_size()):
            if m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i):
                continue
            piece = m.id_to_piece(i)
            # pieces that can't occur: upper case (texts are lower-cased), white space, the mark elsewhere than first
            if MARK in piece[1:] or any("A" <= c <= "Z" or c in " \t\n\r\x0b\x0c" for c in piece):
                continue
            w[piece] = 1.0 / (2.0 - max(m.get_score(i), -1e6))
        total = sum(w.values())
        spare = 0.02 * total  # for bytes and the end
        whole = total + spare
        return cls({p: math.log(x / whole) for p, x in w.items()}, [math.log(spare / 257 / whole)] * 256, math.log(spare / 257 / whole))

    def edges(self, s: str) -> list[list[tuple[int, float]]]:
        """For each place j the lattice's edges that end there, as (start, log weight). A start is left as soon as no piece goes on."""
        get, n = self.begins.get, len(s)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            j = i + 1
            while j <= n:
                p = get(s[i:j])
                if p is None:
                    break
                if p < 0.0:
                    ends[j].append((i, p))
                j += 1
            if s[i] not in self.logp:
                ends[i + 1].append((i, self.spelt(s[i])))
        return ends

    def forward(self, ends: list[list[tuple[int, float]]]) -> list[float]:
        """alpha[j]: log of the summed probability of all segmentations of the first j characters."""
        alpha = [0.0]
        exp, log = math.exp, math.log
        for edges in ends[1:]:
            if len(edges) == 1:
                i, p = edges[0]
                alpha.append(alpha[i] + p)
            else:
                terms = [alpha[i] + p for i, p in edges]
                top = max(terms)
                alpha.append(top + log(sum([exp(t - top) for t in terms])))
        return alpha

    def spelt(self, char: str) -> float:
        return sum(self.byte_logp[b] for b in char.encode("utf-8", "surrogatepass"))

    def log_probability(self, word: str) -> float:
        return self.forward(self.edges(MARK + word))[-1]

    def expect(self, word: str, count: float, into: dict[str, float]) -> None:
        """Add the expected number of uses of each piece in `count` occurrences of the word.

        Going back from the end, an edge's share of its end's uses is its term over the end's sum.
        """
        s = MARK + word
        ends = self.edges(s)
        alpha = self.forward(ends)
        exp = math.exp
        uses = [0.0] * len(alpha)
        uses[-1] = count
        for j in range(len(alpha) - 1, 0, -1):
            u, edges = uses[j], ends[j]
            if u <= 0.0:
                continue
            for i, p in edges:
                share = u if len(edges) == 1 else u * exp(alpha[i] + p - alpha[j])
                uses[i] += share
                piece = s[i:j]
                if piece in self.logp:
                    into[piece] += share
                else:
                    for b in piece.encode("utf-8", "surrogatepass"):
                        into[f"<{b}>"] += share

    def reestimated(self, expected: dict[str, float], ends: float, pseudo: float = 1000.0) -> Lattice:
        """New weights: expected counts plus `pseudo` counts shared by the present weights."""
        total = pseudo + ends + sum(expected.values())
        new = lambda key, old: math.log((expected.get(key, 0.0) + pseudo * math.exp(old)) / total)
        return Lattice(
            {p: new(p, x) for p, x in self.logp.items()}, [new(f"<{b}>", x) for b, x in enumerate(self.byte_logp)],
            math.log((ends + pseudo * math.exp(self.end_logp)) / total),
        )


BLOCK_DOCS = 16_384
ROWS = "block long, token string, place int, trained long, ids array<long>, held array<boolean>, sizes binary, uses binary"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Arrow batches (doc_id, text, held_out) put together to blocks of at most BLOCK_DOCS rows and, but for one batch, BLOCK_CHARS characters."""
    from pyspark import TaskContext

    no, size, rows, parts = TaskContext.get().partitionId() << 32, 0, 0, []
    for b in batches:
        if not b.num_rows:
            continue
        parts.append(b)
        size += b.column(1).nbytes
        rows += b.num_rows
        if size >= BLOCK_CHARS or rows + BATCH_ROWS > BLOCK_DOCS:
            yield no, pa.Table.from_batches(parts)
            no, size, rows, parts = no + 1, 0, 0, []
    if parts:
        yield no, pa.Table.from_batches(parts)


def _uses(block: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """A block's distinct tokens, and by token then document (token's place, document's place, number of uses)."""
    texts = block.column(1).combine_chunks().fill_null("")
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    n = block.num_rows
    coded = split.flatten().dictionary_encode()
    tokens = coded.dictionary.to_pylist()
    # text that begins or ends with white space yields an empty piece there, which stands for the end instead: one a document
    code, doc = coded.indices.to_numpy(zero_copy_only=False), pc.list_parent_indices(split).to_numpy(zero_copy_only=False)
    if "" in tokens:
        full = code != tokens.index("")
        code, doc = code[full], doc[full]
        tokens[tokens.index("")], end = END, tokens.index("")
    else:
        end = len(tokens)
        tokens.append(END)
    key = np.concatenate([code.astype(np.int64) * n + doc, end * n + np.arange(n)])
    del code, doc, coded, split
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    times = np.diff(np.append(first, len(key)))
    key = key[first]
    return pa.array(tokens, pa.string()), key // n, key % n, times


def blocks(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text, held_out) as blocks, in two kinds of rows.

    With a token: the block's distinct tokens, their place in the block's list, and their uses in training rows. Without: the block's ids and folds, for
    each token in the list's order the number of its (document, uses) pairs, and the pairs as 16-bit numbers.
    """
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary()]
    names = [x.split()[0] for x in ROWS.split(", ")]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for no, block in _read(batches):
            tokens, place, doc, times = _uses(block)
            held = block.column(2).combine_chunks().fill_null(False)
            open_ = ~held.to_numpy(zero_copy_only=False)
            trained = np.bincount(place, times * open_[doc], len(tokens)).astype(np.int64)
            for at in range(0, len(tokens), 50_000):
                n = min(50_000, len(tokens) - at)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, no)), tokens.slice(at, n), pa.array(np.arange(at, at + n, dtype=np.int32)), pa.array(trained[at : at + n]), *[pa.nulls(n, k) for k in kinds[4:]]], names)
            while (over := times > 65_535).any():  # a pair holds 16 bits: more uses are more pairs
                place, doc = np.concatenate([place, place[over]]), np.concatenate([doc, doc[over]])
                times = np.concatenate([np.where(over, 65_535, times), times[over] - 65_535])
            order = np.argsort(place, kind="stable")
            pairs = np.stack([doc[order], times[order]], axis=1).astype(np.uint16)
            sizes = np.bincount(place, minlength=len(tokens)).astype(np.int32)
            row = [no, None, None, None, block.column(0).to_pylist(), held.to_pylist(), sizes.tobytes(), pairs.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names)

    return docs.mapInArrow(make, ROWS)


def score(docs: DataFrame, model_file: str, em_steps: int = 1) -> DataFrame:
    """`docs` (doc_id, text, held_out boolean) scored by a model of the rows not held out.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens (long), base_score (additively smoothed word unigrams) and score (the lattice's), log10.
    """
    bounded_batches(docs.sparkSession)
    made = materialize(blocks(docs.select("doc_id", "text", "held_out")), "lm-blocks")
    dealt, users = made.where("token IS NOT NULL").select("block", "token", "place", "trained"), made.where("token IS NULL").select(F.col("block").alias("own"), "ids", "held", "sizes", "uses")
    counts = materialize(dealt.groupBy("token").agg(F.sum("trained").alias("c")), "lm-counts")
    facts = counts.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.coalesce(F.sum(F.when(F.col("token") == END, F.col("c"))), F.lit(0)).alias("ends")).first()
    n, v, ends = int(facts["n"]), int(facts["v"]), int(facts["ends"])
    lattice = Lattice.load(model_file)
    for _ in range(em_steps if n else 0):
        lattice = lattice.reestimated(_expected(counts.where("c > 0"), lattice), ends)
    rated = _rated(counts, lattice)
    met = dealt.select("block", "token", "place").join(rated, "token").select("block", "place", "c", "logp")
    # a training vocabulary of zero tokens: (c+1)/(0+1*(0+1)) = 1, log 0
    smooth = math.log10(n + v + 1)
    found = users.groupBy("own").cogroup(met.groupBy("block")).applyInPandas(lambda block, words: _fold(block, words, smooth), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def _fold(block: pd.DataFrame, words: pd.DataFrame, smooth: float) -> pd.DataFrame:
    """Sum a block's tokens by document."""
    head = block.iloc[0]
    ids = list(head["ids"])
    place = words["place"].to_numpy()
    c, logp = np.empty(len(words)), np.empty(len(words))
    c[place], logp[place] = words["c"].to_numpy(np.float64), words["logp"].to_numpy(np.float64)
    sizes = np.frombuffer(head["sizes"], np.int32)
    pairs = np.frombuffer(head["uses"], np.uint16).reshape(-1, 2)
    doc, times = pairs[:, 0].astype(np.int64), pairs[:, 1].astype(np.float64)
    total = lambda x: np.bincount(doc, times * np.repeat(x, sizes), len(ids))
    return pd.DataFrame({
        "doc_id": pd.array([None if i is None or i != i else int(i) for i in ids], dtype="Int64"), "held_out": list(head["held"]), "n_tokens": total(np.ones(len(c))).astype(np.int64), "n_known": total((c > 0).astype(np.float64)).astype(np.int64),
        "base_score": total(np.log10(c + 1) - smooth), "score": total(logp) / math.log(10),
    })


def _expected(counts: DataFrame, lattice: Lattice) -> dict[str, float]:
    """Expected piece counts over the training words: one row a piece and task is shuffled, one a piece collected."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into: dict[str, float] = defaultdict(float)
        for b in batches:
            for w, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if w != END:
                    lattice.expect(w, c, into)
        yield pa.RecordBatch.from_arrays([pa.array(list(into), pa.string()), pa.array(list(into.values()), pa.float64())], ["piece", "n"])

    found = counts.select("token", "c").mapInArrow(work, "piece string, n double").groupBy("piece").agg(F.sum("n").alias("n"))
    return {r["piece"]: r["n"] for r in found.collect()}


def _rated(counts: DataFrame, lattice: Lattice) -> DataFrame:
    """`counts` (token, c) with each token's log probability under the lattice."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rate = [lattice.end_logp if w == END else lattice.log_probability(w) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rate, pa.float64())], ["token", "c", "logp"])

    return counts.select("token", "c").mapInArrow(work, "token string, c long, logp double")
