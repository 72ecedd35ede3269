import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import onebit_ann as N


def brute(rows, queries, k):
    out = {}
    for q, v in queries:
        d = sorted((float(np.sqrt(((np.array(x, np.float64) - np.array(v, np.float64)) ** 2).sum())), i) for i, x in rows if i != q)
        out[q] = [i for _, i in d[:k]]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(1)
    c = r.standard_normal((6, 32)) * 2
    x = c[r.integers(0, 6, 900)] + r.standard_normal((900, 32)) * 0.4
    x[300:500] = x[300]  # one very common vector
    return [(k, v.tolist()) for k, v in enumerate(x)]


def test_recall_and_order(spark, rows):
    df = frame(spark, rows)
    got = N.search(df, df.where("vec_id % 20 = 0"), 10, query_block=20, rows_a_cell=60, sample=200).orderBy("query_id", "rank").collect()
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 10)
    hit = 0
    for q, ids in want.items():
        mine = [r for r in got if r.query_id == q]
        assert [r.rank for r in mine] == list(range(1, 11)) and [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        hit += len({r.vec_id for r in mine} & set(ids))
    assert hit >= 0.99 * 10 * len(want)
    same = [r.vec_id for r in got if r.query_id == 400]
    assert same == [300 + k for k in range(10)]  # copies: the smallest ids first, never the query itself


@pytest.mark.parametrize("d", [16, 64, 100])
def test_estimates_lie_within_bounds(d):
    r = np.random.default_rng(2)
    x, q = r.standard_normal((4000, d)), r.standard_normal((5, d))
    c = N.Codec(x.mean(axis=0))
    code, size, own = c.encode(x)
    assert code.dtype == np.uint64 and code.shape == (4000, -(-d // 64))
    _, unit = c.rotated(q)
    _, real = c.rotated(x)
    asked = N.Asked.of(c, q)
    got = asked.products(np.arange(5), code, d)
    low, step = asked.low[:, None], asked.step[:, None]
    rounded = low + step * np.rint((unit - low) / step)
    assert np.allclose(got, rounded @ np.where(real > 0, 1, -1).T / np.sqrt(d))  # the bits in common give the product itself
    about = got / own
    slack = 3 * np.sqrt((1 - own**2) / own**2 / (d - 1)) + 3 * asked.error[:, None] / np.sqrt(d) / own
    assert (np.abs(about - unit @ real.T) <= slack).mean() > 0.99 and abs((about - unit @ real.T).mean()) < 0.01
    assert np.allclose(c.turn @ c.turn.T, np.eye(d))


def test_far_cells_are_passed_over(rows, monkeypatch):
    x = np.array([v for _, v in rows])
    cells, codec = N.centres(x, 6, 1), N.Codec(x.mean(axis=0))
    limit = N.first_limits(np.array([0]), x[:1], np.arange(len(x)), x, 10)
    s, seen = N.Searcher(codec, cells, np.array([0]), x[:1], limit, 10, 3.0), []
    monkeypatch.setattr(N.Asked, "products", lambda self, which, codes, d: seen.append(len(codes)) or np.ones((len(which), len(codes))))
    at = N._nearest_centre(x, cells)
    for c in range(6):
        s.look(c, np.arange(len(x))[at == c], x[at == c], *(y[at == c] for y in codec.encode(x)))
    assert 0 < sum(seen) < len(x) / 2
    assert [i for i in s.found()[1]] == [i for _, i in sorted((float(np.sqrt(((v - x[0]) ** 2).sum())), i) for i, v in enumerate(x) if i)[:10]]


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1, 0]), (1, [0, 1]), (2, None), (3, [0, 0]), (4, [1, None]), (5, [nan, 1]), (6, [inf, 1]), (7, [1, 2, 3]), (None, [1, 1]), (100, None), (200, [0, 0]), (300, [1, 0])]
    df = frame(spark, rows).select("*", F.lit("x").alias("score"), F.lit("y").alias("v"), F.lit(1).alias("code"))
    got = sorted((r.query_id, r.rank, r.vec_id) for r in N.search(df, df.where("vec_id % 100 = 0"), 10).collect())
    assert got == [(0, 1, 300), (0, 2, 1), (300, 1, 0), (300, 2, 1)]


def test_each_length_is_a_search_of_its_own(spark):
    rows = [(k, [k, 1]) for k in range(1, 8)] + [(k, [k, 1, 0]) for k in range(100, 105)] + [(200, [3, 1])]
    got = sorted((r.query_id, r.rank, r.vec_id) for r in N.search(frame(spark, rows), frame(spark, rows).where("vec_id % 100 = 0"), 2).collect())
    assert got == [(100, 1, 101), (100, 2, 102), (200, 1, 3), (200, 2, 2)]


def test_few_or_no_rows(spark):
    df = frame(spark, [(0, [1.0, 2.0])])
    assert N.search(df, df).collect() == []
    assert N.search(df.where("false"), df.where("false")).collect() == []
    same = frame(spark, [(k, [1.0, 1.0]) for k in range(5)])
    assert [(r.vec_id, r.score) for r in N.search(same, same.where("vec_id = 0"), 3).orderBy("rank").collect()] == [(1, 0.0), (2, 0.0), (3, 0.0)]


def test_every_row_is_a_candidate(spark):
    df = frame(spark, [(0, [0.0, 1.0]), (0, [0.0, 1.0]), *[(1, [0.0, 2.0])] * 2, (1, [0.0, 5.0]), (2, [0.0, 3.0]), (3, [0.0, 4.0])])
    got = [(r.rank, r.vec_id, r.score) for r in N.search(df, df.where("vec_id = 0"), 4).orderBy("rank").collect()]
    assert got == [(1, 1, 1.0), (2, 1, 1.0), (3, 2, 2.0), (4, 3, 3.0)]


def test_the_statement_says_the_same(spark, rows, tmp_path):
    import duckdb

    from corvane.llm import queries

    frame(spark, [*rows, rows[0], rows[0], rows[37], (100, [1.0] * 32), (5000, [1.0, 2.0]), (5100, [2.0, 2.0])]).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.execute(queries.ORACLE_SQL["op10_onebit_neighbours"]).fetchall())
    got = sorted(tuple(r) for r in queries.op10_onebit_neighbours(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect())
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)
