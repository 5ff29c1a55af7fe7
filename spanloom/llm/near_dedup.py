"""Near-duplicate classes by BagMinHash over the multiset of five-word shingles.

Signature. A shingle of weight w (its count in the text) owns Poisson processes over the discretised weights: one for
each dyadic interval (0,1], (1,2], (2,4], ... up to w; in the last one a point counts only if its own weight
coordinate is at most w. A point has a time and a register; a register keeps the least time. Two texts agree in a
register with the probability of their weighted Jaccard similarity, without bias. Only points before a horizon are
generated; it is set so that every register is nearly surely hit, and doubled for a text where one was not, so the
result is exact and the work is about m log m points plus one draw a shingle, however long the text.

Candidates. Registers are banded; texts that agree in a band share a bucket, whose least text leads it. No pair is
emitted but every member with its leader.

Verification, in two steps, each by the exact multiset overlap of whole texts (shingles as 64-bit hashes).
Step one: pairs of member and leader that differ in size by more than the threshold allows, or in more registers than
chance ever would, are dropped before any text moves; a leader then meets its members in tasks of a bounded number of
shingles, the leader's text going to each. A group of copies of any size is linked to its leader by work in proportion.
Step two: what the links of step one join is known. In a bucket whose other members still are of several components,
those outside its largest component meet all its members, again in tasks of bounded size; texts that are joined
already aren't compared. Every pair that shares a bucket has then been compared or is joined, so no link is lost.
Step two costs, for a bucket, its members times its members outside the largest component: nothing where copies agree
with their leader, and only in compared hashes, never in rows that go to one task, where they don't.

Equal texts are one node throughout (by 128-bit digest), so copies cost a row each and nothing more.

Defined cases: a text that is null or has no word is alone in its class; one of fewer than five words is a single
shingle; a class is named by the least doc_id in it (null only if all are null); rows that repeat an id are judged by
their texts; an empty table gives no rows; further columns of any name are ignored (``classes``) or kept
(``deduplicated``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.common import Scratch, materialize, n_words, table
from spanloom.llm.components import components

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 5
#: Registers hit on average by the horizon: log(m) plus this.
SLACK = 2.5
#: Points of a process that are drawn at once, at most.
POINTS = 256
#: Characters of text that are turned into arrays at once.
TEXT_AT_ONCE = 2_000_000
#: Shingles of the members that meet a leader in one task, about, and as multiples of the leader's own at least.
STAR_SHINGLES, STAR_LEADERS = 16_384, 16
#: Shingles of a chunk in step two, about; a task holds two chunks at most.
CHUNK_SHINGLES = 100_000
#: Shares of a bucket in the join that deals its members to chunks.
SALTS = 32
#: Registers in which a pair at the threshold agrees, less six standard deviations: fewer and it is no link.
AGREEING = math.floor(BANDS * ROWS * THRESHOLD - 6 * math.sqrt(BANDS * ROWS * THRESHOLD * (1 - THRESHOLD)))

#: A broadcast bitmap of texts: 4 MB at most.
BITMAPS, BITMAP_BITS = 1024, 32768

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = x + _A
        x = (x ^ (x >> np.uint64(30))) * _B
        x = (x ^ (x >> np.uint64(27))) * _C
        return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array, size: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of every distinct shingle of every text, ordered by text."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    texts = texts.cast(pa.large_string())
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    owner = np.repeat(np.arange(len(split)), np.diff(split.offsets.to_numpy()))
    flat = split.flatten()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not real.any():
        return none
    owner, coded = owner[real], flat.filter(pa.array(real)).dictionary_encode()
    hashes = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False)
    w = hashes[coded.indices.to_numpy()]
    n = np.bincount(owner, minlength=len(split))
    starts = np.cumsum(n) - n
    with np.errstate(over="ignore"):
        rolled = w.copy()
        for k in range(1, size):
            rolled[: len(w) - k] = rolled[: len(w) - k] * _B + w[k:]
        whole = np.arange(len(w)) - starts[owner] <= n[owner] - size
        key, text = rolled[whole], owner[whole]
        short = np.flatnonzero((n > 0) & (n < size))
        if len(short):
            extra = np.zeros(len(short), np.uint64)
            for k in range(size):
                has = n[short] > k
                extra[has] = extra[has] * _C + w[starts[short[has]] + k] + np.uint64(1)
            key, text = np.concatenate([key, extra]), np.concatenate([text, short])
        # One sort finds equal shingles of a text: the text goes into the key.
        salted = mixed64(key ^ (text.astype(np.uint64) * _C))
    _, at, count = np.unique(salted, return_index=True, return_counts=True)
    order = np.argsort(text[at], kind="stable")
    at = at[order]
    return text[at], mixed64(key[at]), count[order]


def bag_minhash(text: np.ndarray, h: np.ndarray, weight: np.ndarray, n_texts: int, m: int) -> np.ndarray:
    """The (n_texts, m) register times; infinite for a text without shingles."""
    sig = np.full(n_texts * m, np.inf)
    total = np.bincount(text, weights=weight, minlength=n_texts)
    horizon = np.divide(math.log(m) + SLACK, total, out=np.zeros(n_texts), where=total > 0)
    todo = np.ones(len(text), bool)
    while todo.any():
        t_, h_, w_ = text[todo], h[todo], weight[todo]
        _points(sig, t_, h_, w_, horizon, m)
        open_ = (total > 0) & np.isinf(sig.reshape(n_texts, m)).any(axis=1)
        horizon[open_] *= 2
        todo = open_[text]
    return sig.reshape(n_texts, m)


def _points(sig: np.ndarray, text: np.ndarray, h: np.ndarray, weight: np.ndarray, horizon: np.ndarray, m: int) -> None:
    """Lowers the registers by all points of these shingles before their texts' horizons."""
    for k in range(int(weight.max()).bit_length() + 1):
        low, width = (0, 1) if k == 0 else (1 << (k - 1), 1 << (k - 1))
        own = weight > low
        if not own.any():
            break
        t, w = text[own], weight[own]
        with np.errstate(over="ignore"):
            state = mixed64(h[own] + np.uint64(k) * _A)
            time, end, made = np.zeros(len(t)), horizon[t], 0
            while len(t):
                # A few points of each process at once, more where few processes are left; the sums run in their order.
                n = max(1, min(POINTS, POINTS * 32 // len(t)))
                point = mixed64(state[:, None] + np.arange(made + 1, made + n + 1, dtype=np.uint64) * _C)
                made += n
                step = -np.log(((point >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (m * width)
                step[:, 0] += time
                times = np.cumsum(step, axis=1)
                on = times < end[:, None]
                draw = mixed64(point[on] ^ _B)
                row = np.repeat(np.arange(len(t)), on.sum(axis=1))
                slot = t[row] * m + ((draw >> np.uint64(32)) % np.uint64(m)).astype(np.int64)
                if k:  # the point's weight coordinate lies in (low, low + width]
                    hit = low + 1 + ((draw & np.uint64(0xFFFFFFFF)) % np.uint64(width)).astype(np.int64) <= w[row]
                    np.minimum.at(sig, slot[hit], times[on][hit])
                else:
                    np.minimum.at(sig, slot, times[on])
                left = on[:, -1]
                state, time, end, t, w = state[left], times[left, -1], end[left], t[left], w[left]


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n_texts, bands) keys; equal only for texts that agree in all rows of the band."""
    bits = np.ascontiguousarray(sig[:, : bands * rows]).view(np.uint64).reshape(len(sig), bands, rows)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(mixed64(np.arange(bands, dtype=np.uint64)), (len(sig), bands)).copy()
        for r in range(rows):
            key = mixed64(key ^ bits[:, :, r])
    return key.view(np.int64)


def _slices(texts: pa.Array, most: int = TEXT_AT_ONCE) -> Iterator[tuple[int, int]]:
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(size):
        base = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, base + most, side="right")))
        yield start, end
        start = end


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for start, end in _slices(b.column(2)):
            part = b.slice(start, end - start)
            text, h, w = shingles(part.column(2))
            sig = bag_minhash(text, h, w, len(part), BANDS * ROWS)
            keys = band_keys(sig, BANDS, ROWS)
            prints = np.ascontiguousarray((mixed64(sig.view(np.uint64)) & np.uint64(0xFF)).astype(np.uint8))
            prints = pa.array([row.tobytes() for row in prints], pa.binary())
            n = np.bincount(text, weights=w, minlength=len(part)).astype(np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), bands, prints], names=["doc_id", "digest", "n", "bands", "prints"])
        pa.default_memory_pool().release_unused()  # the worker goes on to other stages


class Texts:
    """Texts of one task as sets of dense elements, where an element is a shingle and which of its copies it is."""

    def __init__(self, texts: list[str]):
        text, h, w = shingles(pa.array(texts, pa.large_string()))
        each = np.repeat(np.arange(len(text)), w)
        copy = (np.arange(len(each)) - np.repeat(np.cumsum(w) - w, w)).astype(np.uint64)
        with np.errstate(over="ignore"):
            _, self.element = np.unique(mixed64(h[each] + copy * _A), return_inverse=True)
        self.size = np.bincount(text[each], minlength=len(texts))
        self.start = np.cumsum(self.size) - self.size
        # Where each element occurs: the texts that hold it.
        order = np.argsort(self.element, kind="stable")
        self.holder = text[each][order]
        self.often = np.bincount(self.element)
        self.begin = np.cumsum(self.often) - self.often

    def shared(self, i: int) -> np.ndarray:
        """How many elements every text has in common with one of them."""
        own = self.element[self.start[i] : self.start[i] + self.size[i]]
        often = self.often[own]
        at = np.repeat(self.begin[own] - (np.cumsum(often) - often), often) + np.arange(often.sum())
        return np.bincount(self.holder[at], minlength=len(self.size))

    def links(self, pivots: np.ndarray, label: np.ndarray, threshold: float) -> list[tuple[int, int]]:
        """Pairs of texts that join what the labels tell apart, by overlaps of at least the threshold with the pivots.

        Texts that a pivot is already joined to aren't looked at, and one link stands for all between two labels.
        """
        label, out = label.copy(), []
        for i in pivots.tolist():
            apart = label != label[i]
            if not self.size[i] or not apart.any():
                continue
            shared = self.shared(i)
            near = apart & (shared >= threshold * (self.size + self.size[i] - shared) - 1e-9) & (self.size > 0)
            for j in np.flatnonzero(near).tolist():
                if label[j] != label[i]:
                    out.append((i, j))
                    label[label == label[j]] = label[i]
        return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, i, j, node, pivot, comp, text), ordered by the first four -> (a, b) links found by the tasks."""
    task: tuple | None = None
    nodes: list[int] = []
    pivots: list[int] = []
    comps: list[int] = []
    texts: list[str] = []
    found: list[tuple[int, int]] = []

    def close() -> None:
        if len(nodes) > 1 and pivots:
            label = np.unique(np.array(comps, np.int64), return_inverse=True)[1]
            found.extend((nodes[i], nodes[j]) for i, j in Texts(texts).links(np.array(pivots), label, THRESHOLD))
        for held in (nodes, pivots, comps, texts):
            held.clear()

    def batch() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])
        found.clear()
        return b

    for b in batches:
        for key, i, j, node, pivot, comp, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (key, i, j) != task:
                close()
                task = key, i, j
            if nodes and nodes[-1] == node:  # rows that repeat id and text are one node
                continue
            if pivot:
                pivots.append(len(nodes))
            nodes.append(node), comps.append(comp), texts.append(text)
        if len(found) > 4096:
            yield batch()
    close()
    if found:
        yield batch()


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, prints, prints): the pairs that agree in enough registers."""
    for b in batches:
        if len(b):
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(len(b), -1) for c in b.columns[2:4])
            yield b.filter(pa.array((x == y).sum(axis=1) >= AGREEING)).select(["a", "b", "na", "nb"])


def bitmap(rows: DataFrame, key: str) -> DataFrame:
    """A bit for every key's hash, in BITMAPS rows of 4 KB at most, whatever the number of keys."""
    h = F.xxhash64(key)
    bits = rows.select(F.pmod(F.shiftright(h, 20), F.lit(BITMAPS)).cast("int").alias("__b"), F.pmod(h, F.lit(BITMAP_BITS)).alias("__p"))
    return bits.groupBy("__b").agg(F.bitmap_construct_agg("__p").alias("__m"))


def marked(rows: DataFrame, key: str, bits: DataFrame) -> DataFrame:
    """Adds ``__hit``: whether the key's bit is set. It is for all keys of the bitmap and few others; nothing is
    shuffled to tell."""
    h = F.xxhash64(key)
    placed = rows.withColumns({"__b": F.pmod(F.shiftright(h, 20), F.lit(BITMAPS)).cast("int"), "__p": F.pmod(h, F.lit(BITMAP_BITS)).cast("int")})
    byte = F.conv(F.hex(F.expr("substring(__m, __p div 8 + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, __p % 8)")) != 0, F.lit(False))
    return placed.join(F.broadcast(bits), "__b", "left").withColumn("__hit", hit).drop("__b", "__p", "__m")


def with_bit(rows: DataFrame, key: str, bits: DataFrame) -> DataFrame:
    """The rows whose key's bit is set."""
    return marked(rows, key, bits).where("__hit").drop("__hit")


def _linked(tasks: DataFrame, nodes: DataFrame, keyed: DataFrame, scratch: Scratch) -> DataFrame:
    """The links that tasks (key, i, j, node, pivot, comp) find; texts are fetched for their nodes alone."""
    asked = scratch.keep(tasks.groupBy("node").agg(F.lit(1).alias("one")).join(nodes.select("node", "digest", "rep"), "node").drop("one"), "dedup-asked")
    near = with_bit(keyed, "digest", bitmap(asked, "digest"))
    found = near.join(asked.withColumnRenamed("digest", "d"), (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("node", "text")
    ordered = tasks.join(found, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    return scratch.keep(ordered.select("key", "i", "j", "node", "pivot", "comp", "text").mapInArrow(_verify, "a long, b long"), "dedup-links")


def _stars(members: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Step one's tasks: every leader and a bounded share of its members."""
    pairs = members.where("node <> leader").groupBy(F.col("node").alias("a"), F.col("leader").alias("b")).agg(F.lit(1).alias("one"))
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("prints").alias(f"p{x}"))
    alike = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") >= THRESHOLD * F.greatest("na", "nb") - 1e-9)
    near = scratch.keep(alike.select("a", "b", "pa", "pb", "na", "nb").mapInArrow(_agree, "a long, b long, na long, nb long"), "dedup-pairs")
    leaders = near.groupBy("b").agg(F.ceil(F.sum("na") / F.greatest(F.lit(STAR_SHINGLES), STAR_LEADERS * F.max("nb"))).cast("int").alias("g"))
    chunk = F.pmod(F.xxhash64("a"), F.col("g")).cast("int")
    held = near.join(leaders, "b").select(F.col("b").alias("key"), F.lit(0).alias("i"), chunk.alias("j"), F.col("a").alias("node"), F.lit(False).alias("pivot"))
    lead = leaders.select(F.col("b").alias("key"), F.lit(0).alias("i"), F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("j"), F.col("b").alias("node"), F.lit(True).alias("pivot"))
    return scratch.keep(held.unionByName(lead).withColumn("comp", F.col("node")), "dedup-stars")


def _rest(members: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """Step two's tasks: buckets whose members, but for the leader, are of several components."""
    named = members.where("node <> leader").join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("comp"))
    h = F.xxhash64("node")
    sets = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m"), F.bit_xor(h).alias("x")).where("lo < hi")
    once = sets.groupBy("m", "x").agg(F.min("key").alias("key"))  # bands that agree on a bucket need it once
    open_ = scratch.keep(named.join(once.select("key"), "key"), "dedup-open")
    comps = open_.groupBy("key", "comp").agg(F.sum("n").alias("n"))
    sums = comps.groupBy("key").agg(F.sum("n").alias("all"), F.max(F.struct("n", "comp")).alias("top"))
    chunks = sums.select("key", F.col("top.comp").alias("major"), F.ceil(F.col("all") / CHUNK_SHINGLES).cast("int").alias("g"), F.ceil((F.col("all") - F.col("top.n")) / CHUNK_SHINGLES).cast("int").alias("gp"))
    pivot = F.col("comp") != F.col("major")
    own, mine = F.pmod(h, F.col("g")).cast("int"), F.pmod(F.xxhash64("node", F.lit("pivot")), F.col("gp")).cast("int")
    up_to = lambda g: F.sequence(F.lit(0), F.col(g) - 1)
    column = F.transform(up_to("gp"), lambda i: F.struct(i.alias("i"), own.alias("j")))
    row = F.transform(up_to("g"), lambda j: F.struct(mine.alias("i"), j.alias("j")))
    cells = F.explode(F.when(pivot, F.array_distinct(F.concat(column, row))).otherwise(column)).alias("cell")
    # A hot bucket's rows are dealt by salt as well as by key.
    chunks = chunks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    tasks = open_.withColumn("salt", F.pmod(h, F.lit(SALTS)).cast("int")).join(chunks, ["key", "salt"]).select("key", "node", pivot.alias("pivot"), "comp", cells)
    return scratch.keep(tasks.select("key", "cell.i", "cell.j", "node", "pivot", "comp"), "dedup-rest")


def _classified(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, n) of every row, and (digest, rep, class_id, first) of every distinct text with words.

    ``rep`` is the least id of a text, ``first`` holds for the one text that stands for its class.
    """
    scratch = Scratch(docs.sparkSession)
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce(text_col, F.lit("")))).alias("digest"), F.col(text_col).alias("text"))
    signed = scratch.keep(keyed.mapInArrow(_sign, "doc_id long, digest binary, n long, bands array<long>, prints binary"), "dedup-signed")
    distinct = signed.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("prints").alias("prints"))
    nodes = scratch.keep(distinct.withColumn("node", F.monotonically_increasing_id()), "dedup-nodes")

    banded = nodes.select("node", "n", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("top")).where("leader < top").drop("top")
    members = scratch.keep(banded.join(buckets, "key"), "dedup-members")

    links = _linked(_stars(members, nodes, scratch), nodes, keyed, scratch)
    roots = scratch.keep(components(links), "dedup-roots")
    rest = _rest(members, roots, scratch)
    if not rest.isEmpty():
        more = _linked(rest, nodes, keyed, scratch)
        roots = scratch.keep(components(links.unionByName(more)), "dedup-roots")

    named = scratch.keep(nodes.select("digest", "rep", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "dedup-named")
    heads = named.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("k"), "rep", "digest")).alias("h"))
    texts = named.join(heads, "root").select("digest", "rep", F.col("h.rep").alias("class_id"), (F.col("h.digest") == F.col("digest")).alias("first"))
    out = materialize(signed.select("doc_id", "digest", "n"), "dedup-rows"), materialize(texts, "dedup-classes")
    scratch.delete()
    return out


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id) of every row."""
    rows, texts = _classified(docs, id_col, text_col)
    held = rows.where("n > 0").join(texts, "digest").select("doc_id", "class_id")
    return held.unionByName(rows.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id")))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, that of the least id, with all its columns; rows without words all stay."""
    rows, texts = _classified(docs, id_col, text_col)
    # Texts of which every row but one goes, or all. The others, most as a rule, pass without a shuffle or a join.
    copied = rows.where("n > 0").groupBy("digest").agg(F.count("*").alias("m")).where("m > 1").select("digest")
    touched = materialize(copied.unionByName(texts.where("not first").select("digest")), "dedup-touched")
    text = F.col(f"`{text_col}`")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("digest"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), (n_words(text) == 0).alias("wordless"))
    told = marked(own, "digest", bitmap(touched, "digest"))
    hit = told.where(F.col("__hit") & ~F.col("wordless"))
    first = texts.where("first").select(F.col("digest").alias("d"), "rep")
    found = hit.join(first, (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    one = found.withColumn("k", F.row_number().over(Window.partitionBy("digest", "rep").orderBy(F.col("d")))).where("k = 1")
    return told.where(~F.col("__hit") | F.col("wordless")).select("row.*").unionByName(one.select("row.*"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


#: All pairs with a shingle in common, and who reaches whom over their links.
OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), t AS (
  SELECT row_number() OVER () AS node, text, w, rep FROM (SELECT text, any_value(w) AS w, min(doc_id) AS rep FROM d WHERE len(w) > 0 GROUP BY text)
), s AS (
  SELECT node, shingle, count(*) AS c
  FROM (SELECT node, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS shingle FROM t) GROUP BY ALL
), n AS (SELECT node, sum(c) AS n FROM s GROUP BY node),
p AS (SELECT x.node AS a, y.node AS b, sum(least(x.c, y.c)) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.node < y.node GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.node = a JOIN n nb ON nb.node = b WHERE shared >= 0.8 * (na.n + nb.n - shared) - 0.000000001),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, root) AS (SELECT node, node FROM t UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
c AS (SELECT r.node, min(t.rep) AS class_id FROM r JOIN t ON t.node = r.root GROUP BY r.node)
SELECT d.doc_id, CASE WHEN len(d.w) = 0 THEN d.doc_id ELSE c.class_id END AS class_id
FROM d LEFT JOIN t ON t.text = d.text LEFT JOIN c ON c.node = t.node
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op4_near_dedup": op4_near_dedup}
SQL = {"op4_near_dedup": OP4_SQL}
