import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import mixing
from tests.llm.data import documents


def shares(sizes, weights, cap=3):
    """Targets by resharing what is above the cap until nothing is."""
    total, held = float(sum(sizes)), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in held]
        left, w = total - sum(held.values()), sum(weights[i] for i in free)
        above = [i for i in free if left * weights[i] / w > cap * sizes[i] + 1e-9]
        if not above:
            return [held[i] if i in held else left * weights[i] / w for i in range(len(sizes))]
        held |= {i: cap * float(sizes[i]) for i in above}


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 1000, 1000], [5, 1, 1, 1, 9000, 3], [100, 0, 4, 4, 4, 4, 400]])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    want = shares(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))])
    assert np.allclose([got[f"s{i}"] for i in range(len(sizes))], want)


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(3)
    for n in (3, 10, 500):
        size = rng.integers(1, 5000, n).astype(float)
        p = mixing.flight(np.full(n, 0.37), size, rng)
        assert ((p > 0) & (p < 1)).sum() <= 2
        assert abs(p.sum() - 0.37 * n) < 1e-5 and abs((p * size).sum() - 0.37 * size.sum()) < 1e-2
    same = mixing.flight(np.full(9, 1 / 3), np.ones(9), rng)
    assert same.sum() == pytest.approx(3) and set(np.round(same, 9)) <= {0.0, 1.0}


def test_inclusion_probabilities_hold():
    rng = np.random.default_rng(5)
    size = np.array([1.0, 5, 9, 2, 2, 40, 7, 3, 11, 6])
    got = np.mean([mixing.flight(np.full(10, 0.4), size, rng) for _ in range(3000)], axis=0)
    assert np.abs(got - 0.4).max() < 0.04


@pytest.mark.parametrize("block", [2000, 24])
def test_mix(spark, block):
    docs = documents(spark)
    rows = mixing.mix(docs, block_docs=block).collect()
    assert len(rows) == docs.count() and all(0 <= r.copies <= 3 and r.taken == r.copies * r["size"] for r in rows)
    assert {r.source for r in rows} == {"a", "b", None, "Ä", "zz"} and all(r["size"] == 0 for r in rows if r.doc_id in (200, 201, 204))
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    for rs in by.values():
        assert sum(r["size"] for r in rs) == rs[0].source_size and abs(sum(r.taken for r in rs) - rs[0].target) <= max(60, max(r["size"] for r in rs) / 2)
    again = mixing.mix(docs.repartition(7), block_docs=block)
    assert sorted(map(str, rows)) == sorted(map(str, again.collect()))


def test_rows_that_agree_are_spread(spark):
    docs = spark.createDataFrame([(1, "a b c", "s")] * 300 + [(1, None, "s")] * 7 + [(i, "x " * i, "t") for i in range(2, 300)], "doc_id long, text string, source string")
    rows = mixing.mix(docs, block_docs=24).collect()
    again = mixing.mix(docs.repartition(5), block_docs=24).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again)) and len(rows) == docs.count()
    for s in "st":
        one = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in one) - one[0].target) <= 3
    assert len(mixing.mixed(docs, block_docs=24).collect()) == sum(r.copies for r in rows)


def test_mixed_rows(spark):
    docs = documents(spark).withColumns({"row": F.lit(1), "c": F.lit(2), "nth": F.lit(3), "__before": F.lit(4), "cell": F.lit(5)})
    taken = mixing.mix(docs).agg(F.sum("copies")).first()[0]
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == taken
    assert mixing.mix(docs.where("false")).count() == 0 and mixing.mixed(docs.where("false")).count() == 0
