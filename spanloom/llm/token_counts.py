"""Token counts by heap-and-linked-list byte-pair merging, without emitting an identifier.

The symbols of a segment form a linked list; every adjacent pair that the vocabulary holds stands in a heap by rank.
The lowest-ranked pair (leftmost on ties) is popped and merged, its new neighbours pushed, until none is left. The
count is the initial symbols minus the merges, where a symbol outside the vocabulary weighs its UTF-8 bytes (byte
fallback).

A merge can only cross two characters that stand side by side in some piece of the vocabulary. A text is cut wherever
they don't, which changes no count, and counts of segments are kept in a bounded table per worker, since most recur.

Defined cases: a null text counts as empty, 0 bytes and 0 tokens; special strings in a text are ordinary text; rows
repeat as they come; an empty table gives no rows; further columns are ignored; no text is truncated.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import table

#: Entries of each of a worker's two tables of counts, of words and of their segments.
CACHE_ENTRIES = 500_000
#: The blank of the vocabulary, written for U+0020.
BLANK = "▁"


class PieceCounter:
    """Counts the pieces of a byte-fallback BPE model file with an identity normaliser and a leading blank."""

    def __init__(self, model_file: str, cache_entries: int = CACHE_ENTRIES):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not train.byte_fallback or train.model_type != 2:
            raise ValueError("only byte-fallback BPE models with an identity normaliser are counted")
        self.prefix = BLANK if norm.add_dummy_prefix else ""
        pieces = [p.piece for p in model.pieces if p.type == 1]
        #: The best pieces have the highest score; a rank is the place by score.
        self.rank = {p: i for i, (p, _) in enumerate(sorted(((p.piece, p.score) for p in model.pieces if p.type == 1), key=lambda x: -x[1]))}
        self.inside = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.blank_ends = any(BLANK in p.strip(BLANK) or (p.endswith(BLANK) and p.strip(BLANK)) for p in pieces)
        if self.blank_ends:
            raise ValueError("pieces with a blank behind other characters are not supported")
        self.words: dict[str, int] = {}
        self.parts: dict[str, int] = {}
        self.cache_entries = cache_entries

    def merged(self, segment: str) -> int:
        """The tokens of a segment: heap and linked list."""
        n, rank = len(segment), self.rank
        if n == 1:
            return 1 if segment in rank else len(segment.encode("utf-8"))
        symbols = list(segment)
        get = rank.get
        # A heap entry is rank * n + position; positions are those of left symbols.
        heap = []
        for i in range(n - 1):
            r = get(segment[i : i + 2])
            if r is not None:
                heap.append(r * n + i)
        heapq.heapify(heap)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        merges = 0
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            r, i = divmod(pop(heap), n)
            left = symbols[i]
            if left is None:
                continue
            j = after[i]
            if j >= n:
                continue
            both = left + symbols[j]
            if get(both) != r:
                continue  # one side was merged meanwhile
            merges += 1
            symbols[i], symbols[j] = both, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = get(both + symbols[k])
                if r is not None:
                    push(heap, r * n + i)
            h = before[i]
            if h >= 0:
                r = get(symbols[h] + both)
                if r is not None:
                    push(heap, r * n + h)
        return n - merges + sum(len(c.encode("utf-8")) - 1 for c in symbols if c is not None and len(c) == 1 and c not in rank)

    def segments(self, chunk: str) -> list[str]:
        """The chunk, cut between characters that no piece holds side by side."""
        inside, start, out = self.inside, 0, []
        for i in range(1, len(chunk)):
            if chunk[i - 1 : i + 1] not in inside:
                out.append(chunk[start:i])
                start = i
        out.append(chunk[start:])
        return out

    def _missing(self, chunk: str) -> int:
        parts, total = self.parts, 0
        for s in self.segments(chunk):
            n = parts.get(s)
            if n is None:
                n = self.merged(s)
                if len(s) <= 64:
                    if len(parts) >= self.cache_entries:
                        parts.clear()
                    parts[s] = n
            total += n
        return total

    def count(self, text: str) -> int:
        if not text:
            return 0
        get, total = self.words.get, 0
        words = text.split(" ")
        if "" in words or BLANK in text:  # runs of blanks merge with each other
            chunks = re.findall(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+", self.prefix + text.replace(" ", BLANK))
            return sum(self._missing(c) for c in chunks)
        if not self.prefix:
            total, words = self._missing(words[0]), words[1:]
        for w in words:
            n = get(w)
            if n is None:
                n = self._missing(BLANK + w)
                if len(w) <= 64:
                    if len(self.words) >= self.cache_entries:
                        self.words.clear()
                    self.words[w] = n
            total += n
        return total


_counters: dict[str, PieceCounter] = {}


def counter(model_file: str) -> PieceCounter:
    if model_file not in _counters:
        _counters[model_file] = PieceCounter(model_file)
    return _counters[model_file]


def token_counts(docs: DataFrame, model_file: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; ``model_file`` is opened on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = model_file
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        count = counter(str(path)).count
        for b in batches:
            n = [count(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op9_token_counts": op9_token_counts}
SQL: dict[str, str] = {}
