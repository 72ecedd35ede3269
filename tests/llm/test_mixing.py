import collections
import heapq
import random

from corvane.llm import mixing


def highest_quotients(votes, seats):
    """Sainte-Laguë by a heap; ties to the first name."""
    won = collections.Counter()
    heap = [(-v, k) for k, v in sorted(votes.items()) if v > 0]
    heapq.heapify(heap)
    for _ in range(seats if heap else 0):
        _, k = heapq.heappop(heap)
        won[k] += 1
        heapq.heappush(heap, (-votes[k] / (2 * won[k] + 1), k))
    return won


def test_apportion_is_sainte_lague(spark):
    r = random.Random(4)
    rows, want = [], {}
    for g in range(25):
        votes = {f"p{k:02d}": float(r.choice([0, 1, 5, 7, r.randint(1, 10_000)])) for k in range(r.randint(1, 9))}
        seats = r.choice([0, 1, 3, 17, 1000])
        rows += [(g, k, v, seats) for k, v in votes.items()]
        want |= {(g, k): highest_quotients(votes, seats)[k] for k in votes}
    df = spark.createDataFrame(rows, "g int, p string, vote double, seats long")
    got = {(x.g, x.p): x.quota for x in mixing.apportion(df, ["g"], "vote", "seats", ["p"]).collect()}
    assert got == want


def filled(sizes, weights, total):
    cap = {s: 2.0 * n for s, n in sizes.items()}
    out, open_ = {}, set(sizes)
    while open_:
        level = (total - sum(out.values())) / sum(weights[s] for s in open_)
        full = {s for s in open_ if cap[s] <= weights[s] * level}
        if not full:
            return out | {s: weights[s] * level for s in open_}
        out |= {s: cap[s] for s in full}
        open_ -= full
    return out


def test_mix(docs):
    got = mixing.mix(docs).collect()
    sizes = collections.Counter()
    for r in docs.collect():
        sizes[r.source] += len((r.text or "").encode().split())
    names = sorted([s for s in sizes if s is not None]) + [None]
    goals = filled(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, 1.5 * sum(sizes.values()))
    taken = collections.Counter()
    assert len(got) == docs.count()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and abs(r.target - goals[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
    for s in names:
        assert abs(taken[s] - goals[s]) <= 24, s
    again = sorted((r.doc_id or -1, r.size, r.taken) for r in mixing.mix(docs.repartition(7)).collect())
    assert again == sorted((r.doc_id or -1, r.size, r.taken) for r in got)


def test_small_shards_and_tables(docs, clashing, nothing):
    got = mixing.mix(docs, shard_words=500, shard_rows=5, block=4).collect()
    assert len(got) == docs.count() and all(r.taken <= 2 * r.size for r in got)
    goal = {r.source: r.target for r in got}
    for s in goal:
        assert abs(sum(r.taken for r in got if r.source == s) - goal[s]) <= 60
    assert mixing.mix(clashing).count() == docs.count()
    assert mixing.mix(nothing).collect() == []
    assert all(r.taken == 0 for r in mixing.mix(docs.where("doc_id IN (200, 201, 202)")).collect())
