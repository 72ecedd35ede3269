import itertools
import random
import re

import xxhash

from corvane.llm import simhash


def plain(text, words=3):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + words]), 42) for k in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(codes, radius):
    at = {c: c for c in codes}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in itertools.combinations(codes, 2):
        if (a ^ b).bit_count() <= radius:
            at[find(a)] = find(b)
    return find


def test_masks_cover_every_pair():
    for radius in (0, 1, 2):
        masks = [m % 2**64 for m in simhash.covering_masks(radius)]
        assert len(masks) == 2 ** (radius + 1) - 1
        for n in range(radius + 1):
            for places in itertools.combinations(range(64), n):
                x = sum(1 << p for p in places)
                assert any(x & m == 0 for m in masks)


def test_fingerprints(docs):
    for r in docs.collect():
        assert simhash.fingerprint(r.text) == plain(r.text)
    assert simhash.fingerprint("a b", 5) == plain("a b", 5)


def test_components_against_all_pairs(docs):
    rows = docs.collect()
    code = [plain(r.text) for r in rows]
    find = groups(set(code), 2)
    low = {}
    for r, c in zip(rows, code):
        if r.doc_id is not None:
            low[find(c)] = min(low.get(find(c), r.doc_id), r.doc_id)
    want = sorted((r.doc_id or -1, c, low.get(find(c)) or 0) for r, c in zip(rows, code))
    got = sorted((r.doc_id or -1, r.code % 2**64, r.component_id or 0) for r in simhash.near_duplicates(docs).collect())
    assert got == want


def test_crowded_buckets_and_chains(spark):
    r = random.Random(3)
    codes = {r.getrandbits(64)}
    hub = next(iter(codes))
    for a, b in itertools.combinations(range(40), 2):  # hundreds of codes about one: buckets far beyond the small size
        codes.add(hub ^ (1 << a) ^ (1 << b))
    x = r.getrandbits(64)
    for k in range(0, 60, 2):  # a chain whose ends are far apart
        x ^= (1 << k) ^ (1 << k + 1)
        codes.add(x)
    codes |= {r.getrandbits(64) for _ in range(50)}
    signed = lambda c: c - 2**64 if c >> 63 else c
    nodes = spark.createDataFrame([(signed(c), k) for k, c in enumerate(sorted(codes))], "code long, doc long")
    found = simhash.links(nodes.select("code"), 2, small=8)
    assert all((r.a ^ r.b).bit_count() <= 2 if (r.a < 0) == (r.b < 0) else ((r.a ^ r.b) % 2**64).bit_count() <= 2 for r in found.collect())
    comp = {r.code % 2**64: r.doc for r in simhash.components(nodes, found).collect()}
    find, number = groups(codes, 2), {c: k for k, c in enumerate(sorted(codes))}
    for c in codes:
        same = [number[d] for d in codes if find(d) == find(c)]
        assert comp.get(c, number[c]) == min(same)


def test_radius_one_and_zero_whatever_the_size_of_buckets(spark):
    r = random.Random(9)
    codes = {72, 73, 64, 9} | {1 << a for a in range(30)} | {(1 << a) | 1 for a in range(30)} | {r.getrandbits(64) for _ in range(20)}
    signed = lambda c: c - 2**64 if c >> 63 else c
    nodes = spark.createDataFrame([(signed(c), k) for k, c in enumerate(sorted(codes))], "code long, doc long")
    for radius in (0, 1, 2):
        find = groups(codes, radius)
        for small in (2, 24):
            comp = {x.code % 2**64: x.doc for x in simhash.components(nodes, simhash.links(nodes.select("code"), radius, small)).collect()}
            for k, c in enumerate(sorted(codes)):
                assert comp.get(c, k) == min(j for j, d in enumerate(sorted(codes)) if find(d) == find(c))


def test_awkward_tables(clashing, docs, nothing):
    assert simhash.near_duplicates(clashing).count() == docs.count()
    assert simhash.near_duplicates(nothing).collect() == []
    out = simhash.with_fingerprints(clashing, out="fingerprint")
    assert set(out.columns) == set(clashing.columns) and out.where("fingerprint IS NULL").isEmpty()
