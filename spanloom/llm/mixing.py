"""Mixing sources to target weights by the cube method of balanced sampling.

A source's target over its size is its rate. The whole part of the rate is taken of every document; the fraction is
the inclusion probability of one more copy. The flight phase moves these probabilities three at a time along the
null-space of the two balancing constraints, documents and words, until they are 0 or 1: both totals stay as they
were. It runs on bounded blocks of each source side by side; each block leaves at most two fractional units and
a few of all sizes that it held back, which meet in blocks of their own in the next round, until one block a source is left. Its last two and a dozen units of all
sizes that were held back are the landing problem, solved by trying every outcome for the smallest error.

The moves draw from a generator seeded by source and block, over units in the order of their hashes: reruns agree.

Defined cases: a null text has size 0; a null source is a source of its own, ordered last; a null id is an id; equal
rows are separate units; a source without words has target 0; an empty table gives no rows; further columns are
ignored (``mix``) or kept (``mixed``).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import materialize, n_words, numbered, running, table

WEIGHTS = (5, 2, 1)
#: No source is taken more often than this.
CAP = 3
#: Documents of a block, about, and copies of each source's row for the join with the documents.
BLOCK_DOCS = 2000
SALTS = 32
#: Cells in which rows that agree are numbered.
CELLS = 256
#: Units of a block that its flight leaves alone, for the landing; in a source's last block.
HELD, LAST_HELD = 4, 12
EPS = 1e-9
UNIT = "doc_id long, size long, sid long, p double, base long, nb int, u long"


def targets(sources: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """Adds ``weight`` and ``target`` to (source, source_size, ...): one row a source, of any number.

    The targets are min(cap * size, level * weight); the level rises as capped sources give their excess away, and
    is found by a few sums over the sources.
    """
    weight = reduce(lambda c, iw: F.when(F.col("rank") % len(weights) == iw[0], float(iw[1])).otherwise(c), enumerate(weights), F.lit(float(weights[0])))
    rows = materialize(running(sources, "source", F.lit(1), "rank", "mix-ranges").withColumn("weight", weight), "mix-sources")
    limit = F.col("source_size") * float(cap)
    level, capped = None, -1
    while True:
        above = F.lit(False) if level is None else (F.lit(level) * F.col("weight") > limit)
        total, held, free, n = rows.agg(F.sum("source_size"), F.sum(F.when(above, limit).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))), F.sum(above.cast("long"))).first()
        if not total or not free or n == capped:
            break
        level, capped = (total - held) / free, n
    return rows.withColumn("target", F.least(limit, F.lit(float(level or 0.0)) * F.col("weight")))


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves inclusion probabilities through the null-space of (count, size); at most two stay fractional."""
    p = p.tolist()
    s = size.tolist()
    todo = [i for i, x in enumerate(p) if EPS < x < 1 - EPS]
    draws = iter(rng.random(len(todo) + 8).tolist())
    todo.reverse()
    act: list[int] = []
    while True:
        while len(act) < 3 and todo:
            act.append(todo.pop())
        if len(act) == 3:
            a, b, c = act
            u = (s[b] - s[c], s[c] - s[a], s[a] - s[b])
            if not any(u):
                u = (1, -1, 0)
        elif len(act) == 2 and s[act[0]] == s[act[1]]:
            u = (1, -1)
        else:
            break
        up = down = float("inf")
        for i, d in zip(act, u, strict=True):
            if d > 0:
                up, down = min(up, (1 - p[i]) / d), min(down, p[i] / d)
            elif d < 0:
                up, down = min(up, p[i] / -d), min(down, (1 - p[i]) / -d)
        step = up if next(draws, None) * (up + down) < down else -down
        left = []
        for i, d in zip(act, u, strict=True):
            x = p[i] + step * d
            if x < EPS:
                x = 0.0
            elif x > 1 - EPS:
                x = 1.0
            else:
                left.append(i)
            p[i] = x
        if len(left) == len(act):  # rounding kept all of them off their bounds
            i = min(left, key=lambda k: min(p[k], 1 - p[k]))
            p[i] = float(round(p[i]))
            left.remove(i)
        act = left
    return np.array(p)


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rounds the few fractional units so that words, then documents, are off as little as possible."""
    p = p.copy()
    at = np.flatnonzero((p > 0) & (p < 1))
    picks = (np.arange(1 << len(at))[:, None] >> np.arange(len(at))) & 1
    off = picks - p[at]
    words, docs = np.round(np.abs(off @ size[at]), 6), np.round(np.abs(off.sum(axis=1)), 6)
    p[at] = picks[np.lexsort((docs, words))[0]]
    return p


def sampled(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, held: int, land: bool) -> np.ndarray:
    """Flight, then landing if asked. ``held`` units of all sizes keep out of the flight, so that the landing can even
    out what it leaves; a block that doesn't land hands them on with its last two."""
    p = p.copy()
    p[p <= EPS], p[p >= 1 - EPS] = 0.0, 1.0
    open_ = np.flatnonzero((p > 0) & (p < 1))
    fly = open_[:0]
    if len(open_) > held + 2:
        by_size = open_[np.argsort(size[open_], kind="stable")]
        fly = np.setdiff1d(open_, by_size[np.linspace(0, len(by_size) - 1, held).astype(int)])
    p[fly] = flight(p[fly], size[fly], rng)
    return landing(p, size) if land else p


def _fly(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    sid, block = key
    pdf = pdf.sort_values(["u", "doc_id", "size"], kind="stable", na_position="first").reset_index(drop=True)
    rng = np.random.default_rng([int(sid) & 0xFFFFFFFF, int(block), len(pdf)])
    size = pdf["size"].to_numpy(np.float64)
    last = bool(pdf["nb"].iat[0] == 1)
    p = sampled(pdf["p"].to_numpy(np.float64), size, rng, LAST_HELD if last else HELD, last)
    return pdf[["doc_id", "size", "sid", "base", "nb", "u"]].assign(p=p)[["doc_id", "size", "sid", "p", "base", "nb", "u"]]


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, block_docs: int = BLOCK_DOCS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken): how often each document goes into the mix."""
    if block_docs < 4 * (HELD + 2):
        raise ValueError("a block has to be several times what it hands on")
    sizes = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"))
    rows = materialize(sizes.withColumn("h", F.xxhash64("doc_id", "source", "size")).withColumn("cell", F.spark_partition_id() % CELLS), "mix-sizes")
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, cap)
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(cap)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    whole = F.floor(rate + EPS)
    sources = materialize(sources.select("source", F.col("rank").cast("long").alias("sid"), "source_size", "target", "n", whole.alias("base"), F.greatest(rate - whole, F.lit(0.0)).alias("p")), "mix-targets")

    # Rows that agree in id, source and size are numbered, so that each has a hash of its own.
    again = rows.groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select(F.col("h").alias("of"))
    told = rows.join(again, F.col("h") == F.col("of"), "left")
    alike = numbered(told.where("of is not null").drop("of"), ["h", "doc_id", "source", "size"], ["cell"])
    rows = told.where("of is null").drop("of").withColumn("nth", F.lit(0).cast("long")).unionByName(alike)
    u = F.when(F.col("nth") == 0, F.col("h")).otherwise(F.xxhash64("h", "nth"))
    keyed = rows.select("doc_id", "source", "size", u.alias("u"), F.coalesce("source", F.lit("")).alias("k"), F.col("source").isNull().alias("k0")).withColumn("salt", F.pmod("u", F.lit(SALTS)))
    salted = sources.select("sid", "base", "p", "n", F.coalesce("source", F.lit("")).alias("k"), F.col("source").isNull().alias("k0"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    units = keyed.join(salted, ["k", "k0", "salt"]).select("doc_id", "size", "sid", "p", "base", F.ceil(F.col("n") / block_docs).cast("int").alias("nb"), "u")

    def in_blocks(x: DataFrame) -> DataFrame:
        block = F.pmod(F.xxhash64("u", F.lit("block")), F.col("nb")).cast("int")
        return materialize(x.withColumn("block", block).groupBy("sid", "block").applyInPandas(_fly, UNIT), "mix-flight")

    done = []
    most = sources.agg(F.max(F.ceil(F.col("n") / block_docs))).first()[0] or 1
    now = in_blocks(units)
    while most > 1:  # what a block left fractional meets in fewer blocks; one block lands at once
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(now.where(~open_))
        fewer = F.ceil(F.col("nb") * (HELD + 2) / block_docs).cast("int")
        now, most = in_blocks(now.where(open_).withColumn("nb", fewer)), -(-most * (HELD + 2) // block_docs)
    moved = reduce(DataFrame.unionByName, [*done, now])
    named = sources.select("sid", "source", "source_size", "target", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    out = moved.withColumn("salt", F.pmod("u", F.lit(SALTS))).join(named, ["sid", "salt"])
    copies = (F.col("base") + F.round("p").cast("long")).alias("copies")
    return out.select("doc_id", "source", "size", "source_size", "target", copies).withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with all their columns.

    Rows that agree in id, source and size share their copies evenly, what is over going by the hashes of their texts.
    """
    plan = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    same = plan.groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("c"), F.count("*").alias("m")).where("c > 0")
    same = same.select(F.col("doc_id").alias("i"), F.col("source").alias("s"), F.col("size").alias("z"), "c", "m")
    text = F.col(f"`{text_col}`")
    own = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        n_words(text).alias("size"),
        F.pmod(F.xxhash64(text), F.lit(CELLS)).alias("letters"),
        (F.spark_partition_id() % CELLS).alias("cell"),
    )
    found = own.join(same, F.col("doc_id").eqNullSafe(F.col("i")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).drop("i", "s", "z")
    once = found.where("m = 1").withColumn("n", F.col("c"))
    more = numbered(found.where("m > 1"), ["doc_id", "source", "size"], ["letters", "cell"]).withColumn("n", F.expr("c div m") + (F.col("nth") < F.col("c") % F.col("m")).cast("long"))
    rows = once.select("row", "n").unionByName(more.where("n > 0").select("row", "n"))
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select("row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op7_mixing": op7_mixing}
SQL: dict[str, str] = {}
