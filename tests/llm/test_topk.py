import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import topk


def brute(rows, k, is_query):
    fits = lambda v: v and all(x is not None and np.isfinite(x) and abs(64.0 * x) < 2.0**63 for x in v)
    good = [(i, [math.floor(64.0 * float(x)) for x in v]) for i, v in rows if i is not None and fits(v)]
    out = []
    for q, a in good:
        if is_query(q):
            found = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q and len(a) == len(b))[:k]
            out += [(q, r, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for r, (s, i) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize(("n", "k", "block"), [(400, 20, 90), (400, 3, 1000), (10, 20, 1000), (1, 5, 10)])
def test_agrees_with_brute_force(spark, n, k, block):
    rng = np.random.default_rng(n + k)
    rows = [(i, [float(x) for x in rng.normal(size=6).astype(np.float32) * 0.2]) for i in range(n)]
    rows += [(1000, None), (1020, []), (1040, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1060, [float("nan")] * 6), (1080, [float("inf")] * 6), (None, [0.1] * 6)]
    rows += [(1100, [1.0]), (1101, [2.0]), (1120, [0.5, -0.5, 0.5])]  # of other lengths
    rows += [(2000 + i, [0.25] * 6) for i in range(5)]  # ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k=k, block_rows=block).collect())
    assert got == brute(rows, k, lambda i: i % 20 == 0)


def test_large_components(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=4) * 10.0 ** rng.integers(-1, 12)]) for i in range(90)]
    rows += [(100, [1e9] * 4), (120, [1e16] * 4), (121, [1e16] * 4), (140, [1e300, 0.0, 0.0, 0.0]), (160, [1.7e308] * 4), (180, [-1e16] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k=7).collect())
    want = brute(rows, 7, lambda i: i % 20 == 0)
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want]  # scores beyond a long are equal in the result
    assert [g for g, w in zip(got, want, strict=True) if abs(w[3]) < 1 << 62] == [w for w in want if abs(w[3]) < 1 << 62]


def test_repeated_ids(spark):
    rows = [(i % 3 * 20, [float(i), 1.0]) for i in range(30)] + [(7, [1.0, 1.0])] * 4
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df.where("vec_id <> 20"), F.col("vec_id") == 0, k=5, block_rows=6).collect()
    assert len(got) == 5 and {r.query_id for r in got} == {0} and 0 not in {r.vec_id for r in got}


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, F.col("vec_id") % 20 == 0).count() == 0


def test_lists_are_read_in_order_and_once():
    rng = np.random.default_rng(0)
    x = np.floor(rng.normal(size=(500, 12)) * 20)
    q = np.floor(rng.normal(size=(30, 12)) * 20)
    up, down, lists, score = np.maximum(q, 0), np.minimum(q, 0), topk.Lists(x), q @ x.T
    partial, seen, last, gap = np.zeros_like(score), np.zeros(x.shape, int), 0, np.inf
    for depth in (1, 50, 250, 450, 500):
        top, bottom = lists.entries(last, depth)
        seen += (lists.place < 500 - last) & (lists.place >= 500 - depth)
        assert seen.max() == 1 and (seen.sum(axis=0) == depth).all()
        partial += up @ top.T + down @ bottom.T
        high = [a @ b.T for a, b in zip((up, down), lists.frontiers(depth), strict=True)] if depth < 500 else [0, 0]
        low = np.array([lists.slack(depth, one, np.arange(500)) for one in q])
        assert (partial + low <= score).all() and (partial + high[0] + high[1] >= score).all()
        assert np.allclose(partial + [lists.rest(depth, one, np.arange(500)) for one in q], score)
        assert (high[0] + high[1] - low).sum() <= gap
        gap, last = (high[0] + high[1] - low).sum(), depth
    assert gap == 0


def test_stops_before_the_end_where_few_dimensions_decide(monkeypatch):
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(5000, 2)) * 64)
    q, depths = x[:40], []
    read = topk.Lists.entries
    monkeypatch.setattr(topk.Lists, "entries", lambda self, a, b: depths.append(b) or read(self, a, b))
    got = topk.nra(np.arange(5000), x, np.arange(40), q, 20, unread=0.9)
    assert len(got) == 800 and max(depths) < 5000
