import collections
import math
import random
import re

from awkward import prose
from pyspark.sql import functions as F

from corvane.llm import toxicity as X

BAD = ["moron", "trash", "vequille"]


def planted(n, seed=1):
    """(doc_id, text, toxic): every fourth text has rude words among its own."""
    r, out = random.Random(seed), []
    for i in range(n):
        w = prose(40, 10_000 + i * 3 + seed).split(" ")
        bad = i % 4 == 0
        for _ in range(4 if bad else 0):
            w.insert(r.randrange(len(w)), r.choice(BAD))
        out.append((i, " ".join(w), int(bad)))
    return out


def test_held_out_accuracy(spark):
    rows = planted(600)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = X.fit(df.where("doc_id % 5 <> 0"))
    assert set(BAD) <= set(model.words)
    got = X.with_scores(df.where("doc_id % 5 = 0"), model).collect()
    wrong = [r for r in got if (r.score >= 0.5) != bool(r.toxic)]
    assert len(wrong) <= len(got) * 0.03 and all(0 <= r.score <= 1 for r in got)


def plain_fit(rows, keys, z=3.5, z_pairs=5.0):
    """Words and pairs of the model in plain Python: rows (doc_id, text, toxic), keys id -> keyed hash."""
    def level(n, e, z):
        room = max(0.75, z * math.sqrt(e + 0.25))
        return e if abs(n - e) <= room else n - math.copysign(room, n - e)

    def evidence(n, e, z):
        one, none = ((level(x, y, z) + 0.5) / (y + 0.5) for x, y in zip(n, e))
        return math.log(one) - math.log(none)

    texts = {}
    for i, t, y in sorted(rows, key=lambda r: (keys[r[0]], r[0])):
        texts.setdefault(t, (keys[i], y))
    words, pairs = collections.defaultdict(lambda: [0, 0]), collections.defaultdict(lambda: [0, 0])
    for t, (k, y) in texts.items():
        if k % 4:
            w = re.findall(X.WORD, t.lower())
            for x in set(w):
                words[x][1 - y] += 1
            for x in set(zip(w, w[1:])):
                pairs[x][1 - y] += 1
    t1, t0 = (sum(n[c] for n in words.values()) for c in (0, 1))
    l1 = {w: evidence(n, (sum(n) * t1 / (t1 + t0), sum(n) * t0 / (t1 + t0)), z) for w, n in words.items()}
    l2 = {}
    for (h, w), n in pairs.items():  # all pairs, the rare ones too
        ratio = math.exp(l1[w]) * t1 / t0
        e = sum(n) * ratio / (1 + ratio)
        l2[h, w] = evidence(n, (e, sum(n) - e), z_pairs)
    return {w: x for w, x in l1.items() if x}, {p: x for p, x in l2.items() if x}


def test_as_a_plain_version_says(spark):
    r, rows = random.Random(3), []
    for i, t, y in planted(500, 2):  # a pair that is toxic although its words are not
        w = t.split(" ")
        at = r.randrange(len(w))
        w[at:at] = (["you", "lot"] if y else r.choice([["you", "all"], ["a", "lot"]])) * (i % 3 > 0)
        rows.append((i, " ".join(w), y))
    rows += [(900 + k, rows[k][1], rows[k][2]) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = X.fit(df)
    words, pairs = plain_fit(rows, {x.doc_id: x.k for x in df.select("doc_id", F.xxhash64(F.lit(11), "doc_id").alias("k")).collect()})
    assert model.words.keys() == words.keys() >= set(BAD) and model.pairs.keys() == pairs.keys() >= {("you", "lot")}
    assert all(abs(model.words[w] - x) < 1e-9 for w, x in words.items()) and all(abs(model.pairs[p] - x) < 1e-9 for p, x in pairs.items())


def test_copies_and_bursts_count_once(spark):
    rows = planted(200) + [(1000 + k, "harmless sentence that is copied a lot " + "copied " * 200, 1) for k in range(100)]
    model = X.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert "harmless" not in model.words and "copied" not in model.words


def test_bound_is_kept_and_fit_repeats(spark):
    df = spark.createDataFrame(planted(300), "doc_id long, text string, toxic int")
    a, b = X.fit(df, max_rows=200), X.fit(df.repartition(5), max_rows=200)
    assert a.words == b.words and a.pairs == b.pairs and abs(a.threshold - b.threshold) < 1e-12


def test_evidence_is_a_mean_over_words():
    m = X.Model({"moron": 3.0, "good": -1.0}, {("you", "moron"): 0.5}, 0.1)
    assert abs(m.evidence("You MORON, good day") - (3.0 - 1.0 + 0.5) / 4) < 1e-12
    assert m.evidence("") == m.evidence(None) == 0.0 and m.score(0.1) == 0.5 and m.score(-1) == 0.0 < m.score(0.01) < m.score(1.0) < 1
    assert re.findall(X.WORD, "a-b_c dé9") == ["a", "b", "c", "dé9"]


def test_nothing_to_tell_apart(spark, docs, nothing):
    one = spark.createDataFrame([(1, "a b c", 1), (2, "d e f", 1), (3, None, None)], "doc_id long, text string, toxic int")
    model = X.fit(one)
    assert model.words == {} and all(r.score == 0 for r in X.with_scores(docs, model).collect())
    assert X.fit(nothing.select("doc_id", "text", F.lit(1).alias("toxic"))).words == {}


def test_labels_of_one_id_and_awkward_tables(spark, docs, clashing, nothing):
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (999, 1), (None, 1)], "doc_id long, toxic int")
    assert [(r.doc_id, r.toxic) for r in X.labelled_rows(docs, labels).collect()] == [(1, 1)]
    model = X.Model({"attion": 1.0}, {}, 0.01)
    out = X.with_scores(clashing, model)
    assert out.count() == docs.count() and set(out.columns) == set(clashing.columns) and out.where("score IS NULL OR ids <> 'other'").isEmpty()
    assert X.with_scores(nothing, model).collect() == []
