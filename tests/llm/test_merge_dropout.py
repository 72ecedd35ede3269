import collections
import random
import re

import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from awkward import prose, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import merge_dropout as D
from corvane.llm.queries import PIECE_MODEL

TEXTS = ["", " ", "  Hello  world\nfoo", " x", "a\n\n b\tc\r\n", "ﬁ Ａ é", "\n", "x" * 3000, "{\r\n  };\r\n", "tab\tand\x0bmore", prose(400, 3), "日本語 text " * 20]


@pytest.fixture(scope="module")
def plain():
    return D.Merger(PIECE_MODEL, 0.0)


@pytest.fixture(scope="module")
def merger():
    return D.Merger(PIECE_MODEL, 0.2, seed=3)


def test_without_dropout_it_is_the_library(plain):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    for t in TEXTS:
        assert plain.encode(t) == lib.encode(t)


def test_dropout_varies_and_decodes(merger, plain):
    for t in [*TEXTS, "a▁b ▁ c"]:
        assert merger.decode(merger.encode(t, 5)) == t
        assert merger.encode(t, 5) == merger.encode(t, 5)
    t = prose(400, 3)
    assert len({tuple(merger.encode(t, i)) for i in range(6)}) > 1 and len(merger.encode(t)) > len(plain.encode(t))
    assert D.Merger(PIECE_MODEL, 0.2, seed=4).encode(t) != merger.encode(t)
    assert merger.decode(D.Merger(PIECE_MODEL, 1.0).encode(t)) == t  # nothing merged


def plainly(m, text, doc_id):
    """The agenda in plain Python: at each step the best open candidate of the word, skipped or merged by the hash of its occurrence and number."""
    mask, ids = 2**64 - 1, []

    def mixed(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    start = xxhash.xxh64_intdigest(f"{m.seed}:{doc_id or 0}")
    for place, word in enumerate(re.findall(r" +[^ \n]*|[^ \n]+|\n", " " + text)):
        key, asked = mixed((start + place * 0x9E3779B97F4A7C15) & mask), 0
        parts = [("▁", False) if c == " " else (c, c == "▁") for c in word]
        open_ = [True] * len(parts)  # whether the pair that begins at a part may be asked
        while True:
            ranks = [m._rank.get(a[0] + b[0]) if o and not (a[1] or b[1]) else None for a, b, o in zip(parts, parts[1:], open_)]
            k = min((k for k, r in enumerate(ranks) if r is not None), key=lambda k: (ranks[k], k), default=None)
            if k is None:
                break
            skip = mixed((key + (1 + asked) * 0x94D049BB133111EB) & mask) < int(m.dropout * 2**64)
            asked += 1
            if skip:
                open_[k] = False
                continue
            parts[k : k + 2] = [(parts[k][0] + parts[k + 1][0], False)]
            del open_[k + 1]
            open_[k] = True
            if k:
                open_[k - 1] = True
        for p, literal in parts:
            i = None if literal else m._piece.get(p)
            ids += [m._spell[b] for b in p.encode()] if i is None else [i]
    return ids if text else []


def test_as_a_plain_agenda_says(merger):
    r = random.Random(7)
    texts = [*TEXTS, "a▁b ▁ c", prose(3000, 21, 40), " ".join("".join(r.choice("aabcdeinrst") for _ in range(r.randint(1, 60))) for _ in range(300))]
    texts += [" ".join([w] * 400) for w in ("information", "the", "internationalisation", "q" * 31)]
    for again in range(2):  # with nothing kept, and with cuts kept
        for k, t in enumerate(texts):
            if len(t) < 2000 or k > 9:
                assert merger.encode(t, k) == plainly(merger, t, k)
    together = merger.encode_all(texts, list(range(len(texts))))
    assert [list(memoryview(c).cast("i")) for c in together] == [merger.encode(t, k) for k, t in enumerate(texts)]


def test_every_occurrence_draws_its_own(plain):
    m = D.Merger(PIECE_MODEL, 0.1, seed=8)
    n = 4000
    t = " ".join(["information"] * n)
    ids, cuts = m.encode(t, 1), collections.Counter()
    for w in m.decode(ids).split():
        assert w == "information"
    # one merge is skipped at the rate itself
    two = next(p for p in ("▁a", "▁b", "▁c", "▁s") if p in m._piece and plain._cut([p.replace("▁", " ")], None)[0][1] == 1)
    kept = m.encode(" ".join([two[1:]] * n), 2).count(m._piece[two])
    assert abs(kept / n - 0.9) < 0.02
    pieces = [m._bytes[i].decode() for i in ids]
    cut: list = []
    for p in pieces:
        if p.startswith(" ") and cut:
            cuts[tuple(cut)] += 1
            cut = []
        cut.append(p)
    assert len(cuts) > 12


def test_what_is_kept_changes_nothing(monkeypatch):
    t = prose(2000, 33)
    want = D.Merger(PIECE_MODEL, 0.2, seed=5).encode(t, 4)
    monkeypatch.setattr(D, "_KEEP", 50)
    monkeypatch.setattr(D, "_KEPT", {})
    m = D.Merger(PIECE_MODEL, 0.2, seed=5)
    assert [m.encode(t, 4) for _ in range(3)] == [want] * 3


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_any_text_comes_back(t):
    if any(0xD800 <= ord(c) <= 0xDFFF for c in t):
        return
    m = _ANY
    ids = m.encode(t, 1)
    assert m.decode(ids) == t and m.decode_all(pa.array([ids, None], pa.list_(pa.int32()))) == [t, None]


_ANY = D.Merger(PIECE_MODEL, 0.3, seed=1)


def test_frames(docs, clashing, nothing, merger):
    out = D.decode(D.encode(clashing, merger), merger)
    assert set(out.columns) == set(clashing.columns)
    got = out.collect()
    want = sorted((r[1] or "") for r in rows())
    assert sorted(r.decoded for r in got) == want and all(r.ids == [] for r in got if r.text is None)
    told = D.encode(clashing, merger, verified="score")
    assert told.where("score").count() == len(rows()) and set(told.columns) == set(clashing.columns)
    same = [r.ids for r in got if r.doc_id == 3]
    assert len(same) == 3 and same[0] == same[1] == same[2]
    assert D.decode(D.encode(nothing, merger), merger).collect() == []


def test_bad_parameters():
    with pytest.raises(ValueError):
        D.Merger(PIECE_MODEL, 1.5)
