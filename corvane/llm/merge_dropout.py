"""SentencePiece encoding and decoding with seeded merge-dropout.

The vocabulary is a public merge-type one (pieces with ranks and byte pieces). A text becomes the space mark and the text with spaces as
marks; characters are merged by an agenda of adjacent pairs, best rank first, the leftmost of equals. A candidate taken from the agenda is skipped when its keyed hash falls
below the dropout rate; it comes back only if a neighbour's merge makes the pair anew. The hash is keyed by seed, document, position of the word in the
text and number of the candidate within the word, so every candidate of every occurrence is decided for itself: equal words are cut in many ways, and the same input
always alike.

How a word is cut depends on its letters and the answers its candidates get, so a worker computes each (word, answers) once and keeps it: first the cut without a skip,
which most occurrences get, then those with skips. What is kept is bounded (`_KEEP`) and changes no result.

Decoding joins the pieces' bytes, turns marks into spaces and drops the first: the exact text. A literal mark in a text is spelt in byte pieces, so it stays itself.

With dropout 0 the ids are those of the public library (texts without a literal mark).

Nulls: a null text gives the ids of the empty text, an empty list; a null id counts as id 0. Very long words take n log n steps. Repeated rows
yield equal rows; an empty table an empty one; columns named as an output are replaced, others pass through.
"""

from __future__ import annotations

import gc
import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from corvane.llm.common import BATCH_ROWS, bounded_batches, plus

MARK = "▁"
#: Runs of spaces with the word after them; line breaks and other white space stand alone or within words, they never merge with letters in this vocabulary.
_WORDS = re.compile(r" +[^ \n]*|[^ \n]+|\n")
#: Words, and cuts with skips, that a worker keeps for all tasks of equal parameters; with more than these it begins anew.
_KEEP = 200_000
_KEPT: dict[tuple, Kept] = {}
#: Words up to this length are merged many at a time.
_SHORT = 32
_NEVER = np.int32(2**31 - 1)
#: Candidates of a word whose answers are found for all occurrences at once; a word that asks more goes on by itself.
_ASKED = 24
_GOLDEN, _MIX, _MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


class Kept:
    """What a worker remembers: words by number, their cuts without a skip, and cuts by word and answers."""

    def __init__(self) -> None:
        self.number: defaultdict[str, int] = defaultdict(count().__next__)
        self.cuts: list[bytes] = []
        self.asked = np.zeros(1024, np.int64)  # candidates asked where none is skipped
        self.told: dict[int, bytes] = {}  # by number and as many answers as most cuts ask; empty where the cut asks more
        self.longer: dict[int, bytes] = {}  # by number and all answers

    def new(self) -> list[str]:
        """Words with a number and no cut yet, in the order of their numbers."""
        return list(islice(reversed(self.number), len(self.number) - len(self.cuts)))[::-1]

    def add(self, cuts: list[tuple[bytes, int]]) -> None:
        at, end = len(self.cuts), len(self.cuts) + len(cuts)
        if end > len(self.asked):
            self.asked = np.concatenate([self.asked, np.zeros(end, np.int64)])
        self.asked[at:end] = [n for _, n in cuts]
        self.cuts += [c for c, _ in cuts]

    def full(self) -> bool:
        return len(self.cuts) > _KEEP or len(self.told) + len(self.longer) > 2 * _KEEP


class Merger:
    """Encoder and decoder over one vocabulary file."""

    def __init__(self, model_file: str, dropout: float = 0.1, seed: int = 0):
        if not 0 <= dropout <= 1:
            raise ValueError("dropout lies in [0, 1]")
        self.model_file, self.dropout, self.seed = model_file, dropout, seed
        self._piece: dict[str, int] | None = None

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("model_file", "dropout", "seed")} | {"_piece": None}

    def _load(self) -> None:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=self.model_file)
        self._piece, self._rank, self._bytes, self._spell = {}, {}, [b""] * m.get_piece_size(), [0] * 256
        for i in range(m.get_piece_size()):
            p = m.id_to_piece(i)
            if m.is_byte(i):
                b = int(p[3:5], 16)
                self._bytes[i], self._spell[b] = bytes([b]), i
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                self._piece[p], self._rank[p] = i, -m.get_score(i)
                self._bytes[i] = p.replace(MARK, " ").encode("utf-8")
        self._table = pa.array(self._bytes, pa.binary())
        # characters and pairs as numbers, for merging many words at a time
        self._char = np.full(0x110000, -1, np.int32)
        pairs = []
        for p, i in self._piece.items():
            if len(p) == 1:
                self._char[ord(p)] = i
            for k in range(1, len(p)):
                a, b = self._piece.get(p[:k]), self._piece.get(p[k:])
                if a is not None and b is not None:
                    pairs.append(((a << 32) + b, int(self._rank[p]), i))
        self._pairs(*(np.array(c, np.int64) for c in zip(*pairs)))

    def _pairs(self, key: np.ndarray, rank: np.ndarray, piece: np.ndarray) -> None:
        """A hash table of the pairs that merge: open addressing, at most a quarter full; `_reach` is its longest run of tries."""
        bits = int(len(key) * 4).bit_length()
        self._shift, self._slots = np.uint64(64 - bits), (1 << bits) - 1
        size = self._slots + 1
        self._pair, self._pair_rank, self._pair_id = np.full(size, -1, np.int64), np.full(size, _NEVER, np.int32), np.zeros(size, np.int32)
        at, left, self._reach = self._slot(key), np.arange(len(key)), 0
        while len(left):
            spot = (at[left] + self._reach) & self._slots
            free = self._pair[spot] == -1
            self._pair[spot[free]] = key[left[free]]
            won = self._pair[spot] == key[left]
            self._pair_rank[spot[won]], self._pair_id[spot[won]] = rank[left[won]], piece[left[won]]
            left, self._reach = left[~won], self._reach + 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def encode(self, text: str | None, doc_id: int | None = 0) -> list[int]:
        """The ids of one text."""
        return np.frombuffer(self.encode_all([text], [doc_id])[0], np.int32).tolist()

    def encode_all(self, texts: list[str | None], doc_ids: list[int | None]) -> list[bytes]:
        """The ids of each text, as bytes of int32. Cuts not met lately are computed together."""
        if self._piece is None:
            self._load()
        on = gc.isenabled()
        gc.disable()  # millions of small objects, none of them in a cycle
        try:
            return self._encode_all(texts, doc_ids)
        finally:
            if on:
                gc.enable()

    def _encode_all(self, texts: list[str | None], doc_ids: list[int | None]) -> list[bytes]:
        name = (self.model_file, self.dropout)
        kept = _KEPT.get(name)
        if kept is None or kept.full():
            kept = _KEPT[name] = Kept()
        split = [_WORDS.findall(" " + t) if t else [] for t in texts]
        ends = np.cumsum([0, *map(len, split)])
        flat = list(chain.from_iterable(split))
        numbers = list(map(kept.number.__getitem__, flat))
        kept.add(self._cut(kept.new(), None))
        cuts = list(map(kept.cuts.__getitem__, numbers))
        if self.dropout and flat:
            number = np.array(numbers, np.int64)
            asked = kept.asked[number]
            keys = np.concatenate([self._places(i, len(words)) for i, words in zip(doc_ids, split)])
            changed = np.nonzero(self._any_skip(keys, asked))[0]
            some = changed.tolist()
            for k, cut in zip(some, [] if not some else self._varied(kept, [flat[k] for k in some], number[changed], asked[changed], keys[changed])):
                cuts[k] = cut
        return [b"".join(cuts[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def _places(self, doc_id: int | None, n: int) -> np.ndarray:
        """A key for each of a document's n word positions, by seed and document."""
        start = np.uint64(xxhash.xxh64_intdigest(f"{self.seed}:{doc_id or 0}"))
        return _mixed(start + np.arange(n, dtype=np.uint64) * np.uint64(_GOLDEN))

    def _skip(self, keys: np.ndarray, asked: np.ndarray | int) -> np.ndarray:
        """Whether the candidates of these numbers are skipped at the occurrences of these keys."""
        if self.dropout == 1:
            return np.ones(len(keys), bool)
        return _mixed(keys + (np.uint64(1) + np.atleast_1d(asked).astype(np.uint64)) * np.uint64(_MIX2)) < np.uint64(int(self.dropout * 2**64))

    def _any_skip(self, keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Whether one of the first `asked` candidates is skipped."""
        order = np.argsort(-asked, kind="stable")
        ordered, n, out = keys[order], asked[order], np.zeros(len(keys), bool)
        for t in range(int(n[0])):
            live = int(np.searchsorted(-n, -t, side="left"))  # those that ask more than t
            out[:live] |= self._skip(ordered[:live], t)
        back = np.empty(len(keys), bool)
        back[order] = out
        return back

    def _varied(self, kept: Kept, words: list[str], number: np.ndarray, asked: np.ndarray, keys: np.ndarray) -> list[bytes]:
        """The cut of each word under the answers of its occurrence."""
        answers = np.zeros(len(keys), np.int64)
        for t in range(min(_ASKED, int(asked.max()) + 6)):
            answers |= self._skip(keys, t).astype(np.int64) << t
        # a cut with skips seldom asks more than one candidate beyond those of the cut without
        most = np.minimum(asked + 1, _ASKED)
        code = (number << _ASKED) | (answers & ((1 << most) - 1))
        out: list[bytes | None] = list(map(kept.told.get, code.tolist()))
        open_ = np.array([k for k, c in enumerate(out) if c is None], np.int64)
        if len(open_):
            new, first, which = np.unique(code[open_], return_index=True, return_inverse=True)
            at = open_[first]
            made = self._cut([words[k] for k in at.tolist()], keys[at])
            fits = [cut if n <= m else b"" for (cut, n), m in zip(made, most[at].tolist())]
            kept.told.update(zip(new.tolist(), fits))
            for k, w in zip(open_.tolist(), which.tolist()):
                out[k] = fits[w]
        if b"" in out:
            most = np.minimum(asked + 6, _ASKED)
            code = (number << _ASKED) | (answers & ((1 << most) - 1))
            rest = [k for k, c in enumerate(out) if not c]
            found = list(map(kept.longer.get, code[rest].tolist()))
            rest_at = [k for k, c in zip(rest, found) if c is None]
            for k, c in zip(rest, found):
                out[k] = c
            for k, (cut, n) in zip(rest_at, self._cut([words[k] for k in rest_at], keys[rest_at])):
                out[k] = cut
                if n <= most[k]:
                    kept.longer[int(code[k])] = cut
        return out

    def _cut(self, words: list[str], keys: np.ndarray | None) -> list[tuple[bytes, int]]:
        """The ids of each word at the occurrence of its key (None: without skips), and how many candidates were asked."""
        cuts: list[tuple[bytes, int] | None] = [None] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")  # words of like length make narrow tables
        marked = {k for k, w in enumerate(words) if MARK in w}
        short = [k for k in order[(size[order] > 1) & (size[order] <= _SHORT)].tolist() if k not in marked]
        for at in range(0, len(short), 4096):
            part = short[at : at + 4096]
            for k, cut in zip(part, self._together([words[k] for k in part], None if keys is None else keys[part])):
                cuts[k] = cut
        for k, w in enumerate(words):
            if cuts[k] is None:
                ids, n = self._merge(w, None if keys is None else keys[k])
                cuts[k] = (np.array(ids, np.int32).tobytes(), n)
        return cuts

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each merged pair; _NEVER where there is none."""
        key = (a.astype(np.int64) << 32) + b
        key[(a < 0) | (b < 0)] = -2
        k = self._slot(key)
        for _ in range(self._reach):
            on = self._pair[k] != key
            on &= self._pair[k] != -1
            if not on.any():
                break
            k[on] = (k[on] + 1) & self._slots
        hit = self._pair[k] == key
        return np.where(hit, self._pair_rank[k], _NEVER), self._pair_id[k]

    def _together(self, words: list[str], keys: np.ndarray | None) -> list[tuple[bytes, int] | None]:
        """Many short words at once, one row each: every turn takes each row's best candidate off its agenda, and skips or merges it. None: to be spelt."""
        m, width = len(words), max(map(len, words))
        size = np.fromiter(map(len, words), np.int64, m)
        flat = np.frombuffer("".join(words).replace(" ", MARK).encode("utf-32-le"), np.uint32)
        inside = np.arange(width) < size[:, None]
        # two more columns: an end that no pair goes over, and one that takes what is written beyond the ends
        piece = np.full((m, width + 2), -2, np.int32)
        piece[:, :width][inside] = self._char[flat]
        rank, made = np.full((m, width + 2), _NEVER, np.int32), np.zeros((m, width + 2), np.int32)
        rank[:, : width - 1], made[:, : width - 1] = self._ranks(piece[:, : width - 1], piece[:, 1:width])
        after = np.tile(np.minimum(np.arange(1, width + 3), width + 1).astype(np.int32), (m, 1))
        after[:, :width] = np.where(np.arange(1, width + 1) < size[:, None], after[:, :width], width)
        before = np.tile(np.arange(-1, width + 1).astype(np.int32), (m, 1))
        before[:, 0] = width + 1
        alive = np.zeros((m, width), bool)
        alive[inside] = True
        rows, asked = np.arange(m), np.zeros(m, np.int64)
        while len(rows):
            k = rank[rows].argmin(axis=1)
            open_ = rank[rows, k] < _NEVER
            rows, k = rows[open_], k[open_]
            if keys is not None and len(rows):
                skip = self._skip(keys[rows], asked[rows])
                rank[rows[skip], k[skip]] = _NEVER
                r, k = rows[~skip], k[~skip]
            else:
                r = rows
            asked[rows] += 1
            right = after[r, k]
            beyond, left = after[r, right], before[r, k]
            piece[r, k] = made[r, k]
            rank[r, right] = _NEVER
            alive[r, right] = False
            after[r, k] = beyond
            before[r, beyond] = k
            here = piece[r, k]
            ranks, pieces = self._ranks(np.concatenate([here, piece[r, left]]), np.concatenate([piece[r, beyond], here]))
            rank[r, k], made[r, k] = ranks[: len(r)], pieces[: len(r)]
            rank[r, left], made[r, left] = ranks[len(r) :], pieces[len(r) :]
        ids = piece[:, :width][alive]
        ends = np.cumsum(alive.sum(axis=1)).tolist()
        data, spelt = ids.tobytes(), np.zeros(m, bool)
        spelt[np.nonzero(alive & (piece[:, :width] == -1))[0]] = True
        return [None if s else (data[4 * a : 4 * b], n) for a, b, s, n in zip([0, *ends], ends, spelt.tolist(), asked.tolist())]

    def _merge(self, word: str, key: np.uint64 | None) -> tuple[list[int], int]:
        """One word of any length: a heap of candidates over linked parts. A literal mark stays alone; parts that are no piece are spelt in bytes."""
        rank_of = self._rank.get
        parts: list[str | None] = [MARK if c == " " else c for c in word]
        literal = {k for k, c in enumerate(word) if c == MARK}
        n = len(parts)
        left, right, made_of = list(range(-1, n - 1)), list(range(1, n + 1)), [0] * n
        agenda: list[tuple[float, int, int]] = []
        asked, answers = 0, np.zeros(0, bool)

        def propose(a: int, b: int) -> None:
            if a >= 0:
                made_of[a] += 1  # what was proposed for this place before is void
                if b < n and a not in literal and b not in literal:
                    r = rank_of(parts[a] + parts[b])
                    if r is not None:
                        heapq.heappush(agenda, (r, a, made_of[a]))

        for k in range(n - 1):
            propose(k, k + 1)
        while agenda:
            _, k, stamp = heapq.heappop(agenda)
            if parts[k] is None or stamp != made_of[k]:
                continue
            if key is not None and asked == len(answers):
                more = np.arange(asked, max(32, 2 * asked))
                answers = np.concatenate([answers, self._skip(np.full(len(more), key, np.uint64), more)])
            asked += 1
            if key is not None and answers[asked - 1]:
                continue
            r = right[k]
            parts[k], parts[r] = parts[k] + parts[r], None
            right[k] = right[r]
            if right[r] < n:
                left[right[r]] = k
            propose(left[k], k)
            propose(k, right[k])
        out: list[int] = []
        for k, p in enumerate(parts):
            if p is not None:
                i = None if k in literal else self._piece.get(p)
                out += [self._spell[b] for b in p.encode("utf-8", "surrogatepass")] if i is None else [i]
        return out, asked

    def decode(self, ids: list[int]) -> str:
        if self._piece is None:
            self._load()
        table = self._bytes
        return b"".join([table[i] for i in ids])[1:].decode("utf-8", "surrogatepass")

    def decode_all(self, ids: pa.ListArray) -> list[str | None]:
        """The texts of a column of ids: pieces' bytes are gathered for all at once and cut by text."""
        if self._piece is None:
            self._load()
        ends = np.concatenate([[0], np.cumsum(np.asarray(ids.value_lengths().fill_null(0)))])
        pieces = self._table.take(ids.flatten())
        cut = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1] if len(pieces) else np.zeros(1, np.int32)
        data = memoryview(pieces.buffers()[2]) if len(pieces) and pieces.buffers()[2] is not None else memoryview(b"")
        valid = ids.is_valid().to_pylist()
        at = cut[ends].tolist()
        return [bytes(data[a:b])[1:].decode("utf-8", "surrogatepass") if ok else None for a, b, ok in zip(at, at[1:], valid)]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX2)
    return x ^ (x >> np.uint64(31))


def encode(docs: DataFrame, merger: Merger, out: str = "ids", doc_id: str = "doc_id", text: str = "text", verified: str | None = None) -> DataFrame:
    """All columns of `docs` and the piece ids in `out` (array of int).

    With `verified`, a boolean column of that name: the ids were decoded again and gave the very text (the empty one for a null). It is
    done in the same worker, so a task needs one vocabulary in memory.
    """
    bounded_batches(docs.sparkSession)
    rest = docs.drop(out, *([verified] if verified else []))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, BATCH_ROWS):
                part = b.slice(k, BATCH_ROWS)
                texts = part.column(text).to_pylist()
                ids = merger.encode_all(texts, part.column(doc_id).to_pylist())
                ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                made = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                more = [pa.array([d == (t or "") for d, t in zip(merger.decode_all(made), texts)], pa.bool_())] if verified else []
                yield pa.RecordBatch.from_arrays([*part.columns, made, *more], [*part.schema.names, out, *([verified] if verified else [])])

    return rest.mapInArrow(work, _schema(rest, out, verified))


def decode(coded: DataFrame, merger: Merger, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of `coded` and the decoded text in `out`; null ids give a null text."""
    bounded_batches(coded.sparkSession)
    rest = coded.drop(out) if out in coded.columns else coded

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = merger.decode_all(b.column(ids))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, out])

    return rest.mapInArrow(work, plus(rest, **{out: "string"}))


def _schema(df: DataFrame, out: str, verified: str | None) -> StructType:
    more = [StructField(out, ArrayType(IntegerType()))] + ([StructField(verified, BooleanType())] if verified else [])
    return StructType([*df.schema.fields, *more])
