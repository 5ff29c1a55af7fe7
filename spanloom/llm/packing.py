"""Packing token ids into sequences by Karmarkar-Karp multiway differencing.

A document's ids are cut into full sequences and a tail of pieces. The tails of a block of documents are partitioned
into k windows: a heap holds partial partitions by the spread of their sums; the two of largest spread are merged
with opposing order (the fullest part of one with the emptiest of the other), until one partition is left, whose
windows are nearly equal. k is the least number that could hold the block; if a window exceeds the capacity, k rises
and the differencing runs again. What would leave more than a little padding in every window of a block is first cut
off into sequences whose lengths are powers of two, which need no padding.

Blocks are made of the documents in the order in which a partition reads them, so packing needs no shuffle, holds a
bounded block in memory whatever the sources or copies, and a lost task packs the same again.

Defined cases: a null text is an empty document, which still has its end id; a null id stays null; repeated rows are
packed each; a text of any length is cut into as many sequences as it fills; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import table
from spanloom.llm.encoding import CACHE_ENTRIES, encoder, public_path

CAPACITY = 1024
#: Longest piece of a tail. One tail in LADDER is halved down to single ids: small pieces even the windows out.
PIECE, LADDER = 512, 4
#: Ids that a window of a block has free on average, at least and at most.
LEAST_FREE, MOST_FREE = 1, 2
#: Windows of a block, about.
WINDOWS = 128
#: Documents whose texts are encoded in one call.
DOCS_AT_ONCE = 1024


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """The items' indices in k parts with nearly equal sums."""
    heap = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]  # (minus the spread, tie, parts by falling sum; missing ones are empty)
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        free = k - len(a)
        if len(b) <= free:
            parts = a + b
        else:  # b's largest go to what a has empty, the others to a's smallest
            parts = a[: len(a) - (len(b) - free)] + b[:free]
            parts += [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a[len(a) - (len(b) - free) :], reversed(b[free:]), strict=True)]
        parts.sort(key=lambda x: -x[0])
        spread = parts[0][0] - (parts[-1][0] if len(parts) == k else 0)
        heapq.heappush(heap, (-spread, tie, parts))
        tie += 1
    return [x[1] for x in heap[0][2]] if heap else []


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """As few nearly equal windows as hold the items."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        found = differencing(sizes, k)
        if all(sum(sizes[i] for i in part) <= capacity for part in found):
            return found
        k += 1


def pack_tails(tails: list[tuple[int, int, int]], capacity: int = CAPACITY, piece: int = PIECE) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) from the tails (document, start, length) of a block."""
    items = []
    for i, (d, s, n) in enumerate(tails):
        cuts = [piece] * (n // piece)
        rest = n % piece
        while rest and i % LADDER == 0:
            cuts.append((rest + 1) // 2)
            rest //= 2
        for size in [*cuts, rest] if rest else cuts:
            items.append((d, s, size))
            s += size
    total = sum(n for _, _, n in items)
    k = -(-total // capacity)
    out = []
    if not LEAST_FREE * k <= k * capacity - total <= MOST_FREE * k:  # too tight, or much padding: cut the rest off
        k -= 1
        rest = min(total, total - k * capacity + LEAST_FREE * k)
        items.sort(key=lambda x: x[2])
        lengths = [capacity] * (rest // capacity) + [1 << b for b in reversed(range(capacity.bit_length())) if rest % capacity & 1 << b]
        for need in lengths:
            seq = []
            while need:
                d, s, n = items.pop()
                take = min(n, need)
                seq.append((d, s + n - take, take))
                if take < n:
                    items.append((d, s, n - take))
                need -= take
            out.append(seq)
    if items:
        out += [[items[i] for i in part] for part in windows([n for _, _, n in items], capacity)]
    return out


def pack(docs: DataFrame, path: str | None = None, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """One row a piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids); ids only if wanted.

    ``cache_entries`` bounds the words that a worker remembers: memory against time.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path or public_path("byte_bpe_50k.json"), cache_entries)
        end = np.array([end_id], enc.dtype).tobytes()
        sequence = TaskContext.get().partitionId() << 40
        held: list[tuple] = []  # (doc_id, ids) of the block's documents
        tails: list[tuple[int, int, int]] = []
        waiting = 0
        rows: list[tuple] = []

        def piece(d: int, start: int, n: int, seq: int, offset: int) -> None:
            doc_id, ids = held[d]
            cut = ids[start : start + n]
            row = (doc_id, start, n, zlib.crc32(cut), len(ids), seq, offset)
            rows.append((*row, cut.tobytes()) if with_ids else row)

        def close() -> None:
            nonlocal sequence, waiting
            for seq in pack_tails(tails, capacity):
                offset = 0
                for d, start, n in seq:
                    piece(d, start, n, sequence, offset)
                    offset += n
                sequence += 1
            held.clear(), tails.clear()
            waiting = 0

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids
            b = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows.clear()
            return b

        for b in batches:
            ids_of, texts = b.column(0), b.column(1)
            for at in range(0, len(b), DOCS_AT_ONCE):
                for doc_id, raw in zip(ids_of.slice(at, DOCS_AT_ONCE).to_pylist(), enc.encode(texts.slice(at, DOCS_AT_ONCE)), strict=True):
                    ids = np.frombuffer(raw + end, enc.dtype).astype("<u4")
                    d = len(held)
                    held.append((doc_id, ids))
                    full = len(ids) // capacity * capacity
                    for start in range(0, full, capacity):
                        piece(d, start, capacity, sequence, 0)
                        sequence += 1
                    if full < len(ids):
                        tails.append((d, full, len(ids) - full))
                        waiting += len(ids) - full
                    if waiting >= WINDOWS * capacity or len(rows) > 20_000:
                        close()
                        yield flush()
        close()
        if rows:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op3_packing": op3_packing}
SQL: dict[str, str] = {}
