import math
import random
from fractions import Fraction

import duckdb
import pytest

from verdimill.llm import topk
from verdimill.llm.topk import TOPK_SQL, grid, top_k


def slow(rows, k=20, every=20):
    ok = [(i, [math.floor(Fraction(x) * 64) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % every == 0:
            best = sorted(((-sum(x * y for x, y in zip(a, b)), c) for c, b in ok if c != q and len(a) == len(b)))[:k]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("n", [0, 1, 15, 300])
def test_brute_force(spark, monkeypatch, n):
    monkeypatch.setattr(topk, "SHARD_BLOCK", 32)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "CELL_QUERIES", 2)
    monkeypatch.setattr(topk, "CELL_SHARDS", 2)
    rng = random.Random(n)
    rows = [(i, [rng.choice([-1.5, -0.01, 0.0, 0.3, 0.5]) for _ in range(6)]) for i in range(n)]
    rows += [(1000, None), (1020, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (1040, [float("nan")] * 6), (1060, [float("inf")] * 6), (None, [1.0] * 6), (2000, [1.0, 2.0]), (2001, [0.5, -1.0]), (3000, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS rank", "'q' AS query_id").repartition(5)
    assert sorted(tuple(r) for r in top_k(df).collect()) == slow(rows)


def test_large_values_stay_exact(spark):
    rows = [(i, [2.0**30 + i, float(i % 3), -(2.0**30) - 2 * i]) for i in range(45)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = [(q, r, c, min(s, (1 << 63) - 1)) for q, r, c, s in slow(rows)]
    got = sorted(tuple(r) for r in top_k(df).collect())
    assert [(g[0], g[1], g[3]) for g in got] == [(w[0], w[1], w[3]) for w in want]


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert sorted(tuple(r) for r in top_k(spark.read.parquet(f"{sf}/embeddings.parquet")).collect()) == sorted(con.execute(TOPK_SQL).fetchall())


def test_the_grid_follows_the_number_of_blocks():
    assert grid(0, 0) == grid(5, 100) == (1, 1)
    assert grid(2_500, 50_000) == (1, 13)
    r, c = grid(50_000_000, 1_000_000_000)
    assert r * topk.QUERY_BLOCK * topk.CELL_QUERIES >= 50_000_000 and c * topk.SHARD_BLOCK * topk.CELL_SHARDS >= 1_000_000_000
    assert grid(100_000_000, 2_000_000_000)[0] >= 2 * r - 1


def test_huge_values(spark):
    rows = [(20, [1e308, -0.5]), (1, [1.0, 2.0]), (2, [-1e308, 0.0]), (3, [3e9, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = [(q, r, c, max(-(1 << 63), min(s, (1 << 63) - 1))) for q, r, c, s in slow(rows)]
    assert sorted(r.score for r in top_k(df).collect()) == sorted(w[3] for w in want)


def test_many_rows_with_a_querys_id(spark):
    rng = random.Random(4)
    rows = [(20, [5.0, 5.0, 5.0])] * 60 + [(i, [rng.random(), rng.random(), rng.random()]) for i in range(1, 50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    got, want = sorted(tuple(r)[2:] for r in top_k(df).where("query_id = 40").collect()), sorted(r[2:] for r in con.execute(TOPK_SQL).fetchall() if r[0] == 40)
    assert got == want and len(got) == 20
    assert top_k(df).where("query_id = 20").count() == len([r for r in con.execute(TOPK_SQL).fetchall() if r[0] == 20]) == 20
