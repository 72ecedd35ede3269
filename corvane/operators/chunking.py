"""Chunkers: order-dependent folds within one document, so Python workers, one document at a time and no shuffle."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from corvane.functions import workers

#: Fixed pattern of budget tokens, and what ends a natural unit.
TOKEN = re.compile(r"[A-Za-z0-9]+(?:[._:/-][A-Za-z0-9]+)*|[㐀-鿿]|[^\s]")
STOP = frozenset(".!?;。！？；")
HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*#*$")
NUMBERED = re.compile(r"^(\d+(?:\.\d+){0,5})[.、)\s]\s*(\S.*)$")


def spans(text: str, long: int = 24, piece: int = 16) -> list[tuple[int, int]]:
    """Budget tokens as (start, end); tokens longer than `long` are cut to pieces."""
    out = []
    for m in TOKEN.finditer(text):
        a, b = m.span()
        if b - a <= long:
            out.append((a, b))
        else:
            out += [(k, min(k + piece, b)) for k in range(a, b, piece)]
    return out


def cuts(text: str, tok: list[tuple[int, int]], size: int, overlap: int = 0, natural: bool = True) -> list[tuple[int, int]]:
    """Runs of at most `size` of the tokens `tok`, as index ranges; a run ends at a sentence's or line's end in its last 40 % where there is one."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    out, at = [], 0
    while at < len(tok):
        end = min(at + size, len(tok))
        if natural and end < len(tok):
            for k in range(end, at + int(size * 0.6), -1):
                if text[tok[k - 1][1] - 1] in STOP or "\n" in text[tok[k - 1][1] : tok[k][0]]:
                    end = k
                    break
        out.append((at, end))
        if end == len(tok):
            break
        at = max(at + 1, end - overlap)
    return out


def windows(text: str, size: int, overlap: int = 0, natural: bool = True) -> list[tuple[int, int]]:
    """The same runs as character ranges."""
    tok = spans(text)
    return [(tok[a][0], tok[b - 1][1]) for a, b in cuts(text, tok, size, overlap, natural)]


def sections(text: str) -> list[tuple[str, str]]:
    """(heading, body): Markdown, numbered and capital-letter headings open a section."""
    out: list[tuple[str, list[str]]] = [("", [])]
    for line in text.split("\n"):
        s = line.strip()
        m = HEADING.match(s)
        letters = [c for c in s if c.isalpha()]
        capital = len(letters) >= 3 and len(s) <= 80 and sum(c.isupper() for c in letters) >= 0.9 * len(letters) and s[-1] not in STOP
        if m or (NUMBERED.match(s) and len(s) <= 160 and s[-1] not in STOP) or capital:
            out.append((m[2] if m else s, []))
        else:
            out[-1][1].append(line)
    return [(h, "\n".join(b).strip("\n")) for h, b in out if h or any(x.strip() for x in b)]


def structured(text: str, child: int = 384, overlap: int = 64, parent: int = 1200) -> list[dict]:
    """Parents of at most `parent` tokens within a section, children of at most `child` within a parent."""
    if not 0 <= overlap < child <= parent:
        raise ValueError("need 0 <= overlap < child <= parent")
    out, parents = [], 0
    for title, body in sections(text):
        tok = spans(body)  # once a section: parents and children are ranges of its tokens
        for a, b in cuts(body, tok, parent):
            own = tok[a:b]
            for c, d in cuts(body, own, child, overlap):
                out.append({"position": len(out), "parent": parents, "section_title": title, "content": body[own[c][0] : own[d - 1][1]], "token_count": d - c})
            parents += 1
    return out


def legacy(text: str, size: int = 900, overlap: int = 100) -> list[str]:
    """Greedy fill with paragraphs up to `size` characters, carrying over the last `overlap`; a longer paragraph is sliced."""
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    out, held = [], ""
    for p in (x.strip() for x in re.split(r"\n\s*\n", text)):
        if not p:
            continue
        if held and len(held) + 2 + len(p) > size:
            out.append(held)
            held = held[-overlap:] if overlap else ""
            if held and len(held) + 2 + len(p) > size:
                held = ""
        if not held and len(p) > size:
            step = size - overlap
            parts = [p[k : k + size] for k in range(0, max(len(p) - overlap, 1), step)]
            out += parts[:-1]
            held = parts[-1]
        else:
            held = f"{held}\n\n{p}" if held else p
    if held:
        out.append(held)
    return out


def chunks(docs: DataFrame, version: str = "1.0", **how: int) -> DataFrame:
    """chunk_id, document_id, parent_id, position, section_title, content, token_count of structured chunking."""
    schema = "chunk_id string, document_id string, parent_id string, position int, section_title string, content string, token_count int"

    def make(i: str, t: str) -> Iterator[tuple]:
        for c in structured(t or "", **how):
            yield f"{i}:{version}:{c['position']}", i, f"{i}:{version}:parent:{c['parent']}", c["position"], c["section_title"], c["content"], c["token_count"]

    return workers.flat_map(docs.select("document_id", "content"), make, schema)


def legacy_chunks(docs: DataFrame, size: int = 900, overlap: int = 100) -> DataFrame:
    def make(i: str, t: str) -> Iterator[tuple]:
        return ((i, k, c) for k, c in enumerate(legacy(t or "", size, overlap)))

    return workers.flat_map(docs.select("document_id", "content"), make, "document_id string, position int, content string")


def evidence_units(docs: DataFrame, target: int = 480, most: int = 640) -> DataFrame:
    """Non-overlapping units: flushed at a heading or at `target` tokens, never above `most`."""

    def units(text: str) -> list[tuple[str, str]]:
        out = []
        for title, body in sections(text):
            held: list[str] = []
            n = 0
            for line in body.split("\n"):
                size = len(spans(line))
                if held and (n >= target or n + size > most):
                    out.append((title, "\n".join(held)))
                    held, n = [], 0
                if size > most:
                    out += [(title, line[a:b]) for a, b in windows(line, most)]
                elif size:
                    held.append(line)
                    n += size
            if held:
                out.append((title, "\n".join(held)))
        return out

    def make(i: str, t: str) -> Iterator[tuple]:
        return ((i, k, h, c, len(spans(c))) for k, (h, c) in enumerate(units(t or "")))

    return workers.flat_map(docs.select("document_id", "content"), make, "document_id string, ordinal int, section string, content string, tokens int")
