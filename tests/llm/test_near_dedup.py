from collections import Counter

import numpy as np
import pyarrow as pa

from spanloom.llm import near_dedup as nd
from spanloom.llm.components import components
from tests.llm.data import documents, prose, row, SCHEMA


def bag(text):
    w = (text or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def overlap(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute(rows):
    """{row index: class id} by all pairs."""
    bags = [bag(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[j] and overlap(bags[i], bags[j]) >= 0.8:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return sorted((rows[i][0], min((rows[k][0] for k in g if rows[k][0] is not None), default=None)) for g in groups.values() for i in g if rows[i][0] is not None)


def test_signature_is_unbiased_for_weights():
    rng = np.random.default_rng(0)
    texts = []
    for i in range(120):
        a = [f"w{x}" for x in rng.integers(0, 6 + i % 40, 80 + i)]
        b = a.copy()
        for k in rng.integers(0, len(b), rng.integers(1, 15)):
            b[k] = "z"
        texts += [" ".join(a), " ".join(b)]
    sig = nd.bag_minhash(*nd.shingles(pa.array(texts)), len(texts), 512)
    off = [(sig[2 * i] == sig[2 * i + 1]).mean() - overlap(bag(texts[2 * i]), bag(texts[2 * i + 1])) for i in range(120)]
    assert abs(np.mean(off)) < 0.008 and np.std(off) < 0.04
    heavy = nd.bag_minhash(*nd.shingles(pa.array(["x y z " * 40, "x y z " * 60])), 2, 4096)
    assert abs((heavy[0] == heavy[1]).mean() - overlap(bag("x y z " * 40), bag("x y z " * 60))) < 0.03
    assert np.isinf(nd.bag_minhash(*nd.shingles(pa.array(["", None])), 2, 8)).all()


def test_shingles_are_multisets():
    text, _, count = nd.shingles(pa.array(["a b c d e f", None, "a a a a a a a", "x y"]))
    assert [int(count[text == i].sum()) for i in range(4)] == [2, 0, 3, 1] and (text == 2).sum() == 1


def family(seed, n):
    base = prose(seed, 150).split()
    out = [" ".join(base)]
    for i in range(n):
        w = base.copy()
        for k in range(1 + i % 6):
            w[(k * 37 + i * 11) % len(w)] = f"edit{i}x{k}"
        out.append(" ".join(w))
    return out


def test_classes_agree_with_brute_force(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(family(1, 25) + family(2, 10) + [prose(i, 60) for i in range(50, 70)] + family(1, 3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert sorted(map(tuple, nd.classes(docs).collect())) == want
    monkeypatch.setattr(nd, "CHUNK_SHINGLES", 700)  # buckets in several chunks
    monkeypatch.setattr(nd, "STAR_SHINGLES", 300)
    monkeypatch.setattr(nd, "STAR_LEADERS", 2)
    assert sorted(map(tuple, nd.classes(docs).collect())) == want


def test_edges(spark):
    docs = documents(spark)
    found = [tuple(r) for r in nd.classes(docs).collect()]
    assert len(found) == docs.count()
    of = {i: c for i, c in found if i is not None}
    assert of[101] == of[100] == of[104] == 100 and of[202] == of[203] == 202 and of[200] == 200 and of[201] == 201
    kept = nd.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(100) == 1 and 101 not in ids and 203 not in ids and ids.count(300) in (1, 2) and ids.count(None) == 3
    assert nd.classes(docs.where("false")).count() == 0 and nd.deduplicated(docs.where("false")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == got[102] == 100 and len(got) == 44


def test_bitmap_keeps_all_that_is_asked(spark):
    keys = spark.range(5000).selectExpr("cast(id as string) k")
    asked = keys.where("k like '%7'")
    found = nd.with_bit(keys, "k", nd.bitmap(asked, "k"))
    assert asked.exceptAll(found).count() == 0 and found.count() < 600 and found.columns == ["k"]
    assert nd.marked(keys, "k", nd.bitmap(asked, "k")).count() == 5000
