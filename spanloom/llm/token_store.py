"""Token ids in raw binary shards, with a minimal perfect hash index from document keys to places in them.

Shard file: the magic, the ids of its documents one after the other (little-endian unsigned, 2 or 4 bytes), then the
places at which documents begin and end (u64 each, in ids), then a footer (documents, ids, width, magic). Documents
stand in ascending key order, within a shard and from shard to shard. A task writes the shards of a range of keys; a
shard ends at a number of documents or bytes.

Index file: keys are dealt by hash into files of a bounded number of keys. A key's slot comes from a cascade of bit
arrays: at each level a key that is alone on its bit owns it, the others go on to the next level, so the rank of the
bit is a minimal perfect hash. Bits stand in blocks of 64 bytes, each headed by the rank of its first bit. A slot holds
the key's 32-bit fingerprint and its place (shard, ordinal, rows). ``TokenStore.get`` reads the index file's head, one
block a level it meets (1.6 on average), one slot and two bounds by position, whatever the size of the store; a key
that was never indexed fails the fingerprint, but for a chance of 2**-32. ``read`` is for many keys: it takes whole
index files, then runs of neighbouring documents of a shard in one read each.

Files are written by the tasks under names of their own and moved into place when whole, with the same bytes on a
second attempt, so a lost executor costs only its tasks. All of them lie in the shared folder.

Defined cases: a null text has the end id alone; null keys come first and are one key, which bypasses the index; equal
keys stand together in order of their texts' hashes, over several shards where they are many: the index has the first
place and the places in further shards stand in a table of their own; an empty table makes no files and gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import materialize, new_dir, running, table
from spanloom.llm.encoding import encoder, public_path
from spanloom.llm.files import into_place, open_uri

MAGIC = b"SLTOKEN1"
INDEX_MAGIC = b"SLINDEX2"
FOOTER = "<QQQ8s"
FOOTER_SIZE = struct.calcsize(FOOTER)
#: Documents and bytes at which a shard ends, and keys of an index file, about.
SHARD_DOCS, SHARD_BYTES = 65_536, 64 << 20
INDEX_KEYS = 65_536
DOCS_AT_ONCE = 1024
#: Bytes of texts of a task at most, about; small inputs are dealt to LEAST_TASKS if that gives them TASK_LEAST each.
TASK_BYTES, TASK_LEAST, LEAST_TASKS = 128 << 20, 4 << 20, 48
#: A task's number times this, plus the shard's number in the task, is the shard.
SHARDS_OF_TASK = 1 << 20
#: Bytes of ids that one read fetches at most, and bytes between documents that it may fetch in vain.
READ_BYTES, READ_GAP = 8 << 20, 64 << 10
#: Bytes of a block of an index file's bits, of which the first eight are a rank.
BLOCK = 64
BLOCK_BITS = 8 * (BLOCK - 8)
#: Bits a key at each level, and levels after which the keys left are listed one by one.
GAMMA, LEVELS = 2.0, 40

_P, _Q, _R = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + _P * np.uint64(level + 1)
        x = (x ^ (x >> np.uint64(30))) * _Q
        x = (x ^ (x >> np.uint64(27))) * _R
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Slots 0..n-1 for n distinct 64-bit keys."""

    def __init__(self, sizes: list[int], bits: np.ndarray, rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.base = np.cumsum([0, *sizes])
        self.before = np.cumsum(bits, dtype=np.int64) - bits
        self.placed = int(bits.sum())

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, sizes, parts = keys.astype(np.uint64), [], []
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(64, int(GAMMA * len(left)) // 64 * 64)
            at = (_mix(left, level) % np.uint64(size)).astype(np.int64)
            count = np.bincount(at, minlength=size)
            parts.append((count == 1).astype(np.uint8))
            sizes.append(size)
            left = left[count[at] != 1]
        return cls(sizes, np.concatenate([*parts, np.zeros(0, np.uint8)]), np.sort(left))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot; -1 where no key of the set can be meant."""
        keys = keys.astype(np.uint64)
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                return out
            at = self.base[level] + (_mix(keys[open_], level) % np.uint64(size)).astype(np.int64)
            hit = self.bits[at] == 1
            out[open_[hit]] = self.before[at[hit]]
            open_ = open_[~hit]
        if len(open_) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            hit = self.rest[at] == keys[open_]
            out[open_[hit]] = self.placed + at[hit]
        return out

    def to_bytes(self) -> bytes:
        """The head (levels, keys beside the bits, sizes), the blocks, the keys beside the bits."""
        head = struct.pack(f"<QQ{len(self.sizes)}Q", len(self.sizes), len(self.rest), *self.sizes)
        n = -(-len(self.bits) // BLOCK_BITS)
        bits = np.zeros(n * BLOCK_BITS, np.uint8)
        bits[: len(self.bits)] = self.bits
        ranks = np.concatenate([[0], np.cumsum(bits.reshape(n, BLOCK_BITS).sum(axis=1, dtype=np.int64))[:-1]]) if n else np.zeros(0)
        blocks = np.concatenate([ranks.astype("<u8").view(np.uint8).reshape(n, 8), np.packbits(bits, bitorder="little").reshape(n, BLOCK - 8)], axis=1)
        return head + blocks.tobytes() + self.rest.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> tuple[PerfectHash, int]:
        levels, rest = struct.unpack_from("<QQ", raw)
        sizes = list(struct.unpack_from(f"<{levels}Q", raw, 16))
        at, total = 16 + 8 * levels, sum(sizes)
        n = -(-total // BLOCK_BITS)
        blocks = np.frombuffer(raw, np.uint8, n * BLOCK, at).reshape(n, BLOCK)
        bits = np.unpackbits(np.ascontiguousarray(blocks[:, 8:]).reshape(-1), bitorder="little")[:total]
        at += n * BLOCK
        return cls(sizes, bits, np.frombuffer(raw, "<u8", rest, at)), at + 8 * rest


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys.astype(np.uint64), 1000) >> np.uint64(32)).astype(np.uint32)


PLACE = np.dtype([("print", "<u4"), ("ordinal", "<u4"), ("shard", "<u8"), ("rows", "<u8")])


def index_bytes(keys: np.ndarray, shard: np.ndarray, ordinal: np.ndarray, rows: np.ndarray) -> bytes:
    mph = PerfectHash.build(keys)
    slots = np.zeros(len(keys), PLACE)
    at = mph.slots(keys)
    slots["print"][at], slots["shard"][at], slots["ordinal"][at], slots["rows"][at] = fingerprints(keys), shard, ordinal, rows
    return INDEX_MAGIC + mph.to_bytes() + slots.tobytes()


class Index:
    """One index file in memory."""

    def __init__(self, raw: bytes):
        if raw[:8] != INDEX_MAGIC:
            raise ValueError("not an index file")
        self.mph, at = PerfectHash.from_bytes(raw[8:])
        self.slots = np.frombuffer(raw, PLACE, offset=8 + at)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each key, whether it is there)."""
        at = self.mph.slots(keys)
        if not len(self.slots):
            return np.zeros(len(keys), PLACE), np.zeros(len(keys), bool)
        place = self.slots[np.maximum(at, 0)]
        return place, (at >= 0) & (place["print"] == fingerprints(keys))


class OpenIndex:
    """An index file that is read by position, a key at a time."""

    def __init__(self, file):
        self.file = file
        magic, levels, self.rest = struct.unpack("<8sQQ", file.read_at(24, 0))
        if magic != INDEX_MAGIC:
            raise ValueError("not an index file")
        self.sizes = struct.unpack(f"<{levels}Q", file.read_at(8 * levels, 24))
        self.blocks = 24 + 8 * levels
        self.rest_at = self.blocks + -(-sum(self.sizes) // BLOCK_BITS) * BLOCK
        self.slots_at = self.rest_at + 8 * self.rest

    def slot(self, key: int) -> int:
        one, base = np.array([key], np.uint64), 0
        for level, size in enumerate(self.sizes):
            at = base + int(_mix(one, level)[0] % np.uint64(size))
            block = self.file.read_at(BLOCK, self.blocks + at // BLOCK_BITS * BLOCK)
            bits, k = int.from_bytes(block[8:], "little"), at % BLOCK_BITS
            if bits >> k & 1:
                return int.from_bytes(block[:8], "little") + (bits & (1 << k) - 1).bit_count()
            base += size
        rest = np.frombuffer(self.file.read_at(8 * self.rest, self.rest_at), "<u8")  # hardly ever any
        found = np.flatnonzero(rest == np.uint64(key))
        placed = (self.file.size() - self.slots_at) // PLACE.itemsize - self.rest
        return placed + int(found[0]) if len(found) else -1

    def find(self, key: int) -> tuple[int, int, int] | None:
        """(shard, ordinal, rows) of a key's first place; None if it isn't there."""
        slot = self.slot(key)
        if slot < 0:
            return None
        place = np.frombuffer(self.file.read_at(PLACE.itemsize, self.slots_at + slot * PLACE.itemsize), PLACE)[0]
        same = place["print"] == fingerprints(np.array([key], np.uint64))[0]
        return (int(place["shard"]), int(place["ordinal"]), int(place["rows"])) if same else None


def shard_name(shard: int) -> str:
    return f"shard-{shard:016d}.bin"


def index_name(bucket: int) -> str:
    return f"index-{bucket:07d}.mph"


def key_hash(key: int) -> tuple[int, int]:
    """(hash, hash for the index file) of a key, as Spark's ``xxhash64`` of the key, and of the key and "bucket"."""
    h = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42)
    return h, xxhash.xxh64_intdigest(b"bucket", h)


class Shard:
    """Reads one shard file, by position."""

    def __init__(self, folder: str, shard: int):
        files, path = open_uri(folder)
        self.file = files.open_input_file(f"{path}/{shard_name(shard)}")
        size = self.file.size()
        self.docs, ids, self.width, magic = struct.unpack(FOOTER, self.file.read_at(FOOTER_SIZE, size - FOOTER_SIZE))
        if magic != MAGIC:
            raise ValueError("not a shard file")
        self.bounds_at = size - FOOTER_SIZE - 8 * (self.docs + 1)

    def bounds(self, first: int, rows: int) -> np.ndarray:
        """Where the documents from ``first`` on begin, and where the last of them ends."""
        return np.frombuffer(self.file.read_at(8 * (rows + 1), self.bounds_at + 8 * first), "<u8").astype(np.int64)

    def ids(self, begin: int, end: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((end - begin) * self.width, len(MAGIC) + begin * self.width), f"<u{self.width}")

    def documents(self, ordinals: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(ordinal, begin, ids) of documents in ascending order; neighbours come with one read."""
        if not len(ordinals):
            return
        low = int(ordinals[0])
        bounds = self.bounds(low, int(ordinals[-1]) - low + 1)
        begin, end = bounds[ordinals - low], bounds[ordinals - low + 1]
        at = 0
        while at < len(ordinals):
            apart = np.flatnonzero((begin[at + 1 :] - end[at:-1]) * self.width > READ_GAP)
            upto = at + 1 + int(apart[0]) if len(apart) else len(ordinals)
            upto = max(at + 1, min(upto, int(np.searchsorted(end, begin[at] + READ_BYTES // self.width, side="right"))))
            raw = self.ids(int(begin[at]), int(end[upto - 1]))
            for k in range(at, upto):
                yield int(ordinals[k]), int(begin[k]), raw[begin[k] - begin[at] : end[k] - begin[at]]
            at = upto

    def close(self) -> None:
        self.file.close()


class TokenStore:
    """A written store: folder, number of index files, (shard, docs, first_id) of every shard, and the places that are
    not in the index (null keys, and what equal keys have in further shards) as (doc_id, shard, ordinal, rows)."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int, shards: DataFrame, beside: DataFrame):
        self.spark, self.folder, self.buckets, self.shards, self.beside = spark, folder, buckets, shards, beside

    def get(self, key: int) -> np.ndarray | None:
        """The ids of the first document under a key, by a few reads of fixed size; None if there is none."""
        h, b = key_hash(key)
        signed = b - (1 << 64) if b >> 63 else b
        files, path = open_uri(self.folder)
        try:
            file = files.open_input_file(f"{path}/{index_name(signed % self.buckets)}")
        except FileNotFoundError:
            return None
        with file as f:
            place = OpenIndex(f).find(h)
        if place is None:
            return None
        shard = Shard(self.folder, place[0])
        try:
            begin, end = shard.bounds(place[1], 1)
            return shard.ids(int(begin), int(end))
        finally:
            shard.close()

    def read(self, keys: DataFrame, key_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
        """(doc_id, start, n_tokens, ids_crc32, ids) of every row stored under the keys, through the index; ids only if
        wanted."""
        folder = self.folder

        def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bucket, index = None, None
            for b in batches:
                at, key, h = (b.column(i).to_numpy() for i in range(3))
                for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at)) + 1):
                    if not len(part):
                        continue
                    if at[part[0]] != bucket:
                        bucket = at[part[0]]
                        files, path = open_uri(folder)
                        with files.open_input_file(f"{path}/{index_name(bucket)}") as f:
                            index = Index(f.read())
                    place, there = index.find(h[part].view(np.uint64))
                    place, found = place[there], key[part][there]
                    yield pa.RecordBatch.from_arrays([pa.array(found), *(pa.array(place[c].astype(np.int64)) for c in ("shard", "ordinal", "rows"))], names=["doc_id", "shard", "ordinal", "rows"])

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                key, shard, ordinal, rows, first = (b.column(i).fill_null(0).to_numpy() for i in range(5))
                missing = b.column(0).is_null().to_numpy(zero_copy_only=False)
                for part in np.split(np.arange(len(shard)), np.flatnonzero(np.diff(shard)) + 1):
                    if not len(part):
                        continue
                    source, out = Shard(folder, int(shard[part[0]])), []
                    owner = np.repeat(part, rows[part])
                    ordinals = np.repeat(ordinal[part] - (np.cumsum(rows[part]) - rows[part]), rows[part]) + np.arange(len(owner))
                    for at, (_, begin, ids) in zip(owner.tolist(), source.documents(ordinals), strict=True):
                        wide = ids.astype("<u4")
                        row = (None if missing[at] else int(key[at]), int(first[at]) + begin, len(ids), zlib.crc32(wide))
                        out.append((*row, wide.tobytes()) if with_ids else row)
                        if len(out) >= 4096:
                            yield _batch(out)
                            out = []
                    if out:
                        yield _batch(out)
                    source.close()

        key = F.col(key_col).cast("long")
        asked = keys.select(key.alias("doc_id")).groupBy("doc_id").agg(F.lit(1).alias("one"))
        hashed = asked.where("doc_id is not null").select(F.pmod(F.xxhash64("doc_id", F.lit("bucket")), F.lit(self.buckets)).cast("int").alias("bucket"), "doc_id", F.xxhash64("doc_id").alias("h"))
        dealt = hashed.repartition("bucket").sortWithinPartitions("bucket")
        places = dealt.mapInArrow(locate, "doc_id long, shard long, ordinal long, rows long")
        wanted = asked.select(F.col("doc_id").alias("k"))
        places = places.unionByName(self.beside.join(wanted, F.col("doc_id").eqNullSafe(F.col("k")), "left_semi"))
        known = places.join(self.shards.select("shard", "first_id"), "shard").select("doc_id", "shard", "ordinal", "rows", "first_id")
        in_order = known.repartition("shard").sortWithinPartitions("shard", "ordinal")
        return in_order.mapInArrow(fetch, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.binary()]
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=names[: len(columns)])


def write(docs: DataFrame, folder: str | None = None, path: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS, shard_bytes: int = SHARD_BYTES) -> TokenStore:
    """Encodes every text, appends ``end_id``, writes shards and index under ``folder`` (of the shared folder)."""
    spark = docs.sparkSession
    folder = folder or new_dir(spark, "tokens")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path or public_path("word_bpe_49k.json"))
        end = np.array([end_id], enc.dtype).tobytes()
        shard = TaskContext.get().partitionId() * SHARDS_OF_TASK
        pieces = ((b.column(0).slice(at, DOCS_AT_ONCE).to_pylist(), b.column(1).slice(at, DOCS_AT_ONCE)) for b in batches for at in range(0, len(b), DOCS_AT_ONCE))
        encoded = ((key, raw) for keys, texts in pieces for key, raw in zip(keys, enc.encode(texts), strict=True))
        doc = next(encoded, None)
        while doc is not None:
            keys: list = []
            bounds = [0]

            def body(out) -> None:
                nonlocal doc
                out.write(MAGIC)
                held = []
                while doc is not None and len(keys) < shard_docs and bounds[-1] * enc.width < shard_bytes:
                    keys.append(doc[0])
                    held += [doc[1], end]
                    bounds.append(bounds[-1] + len(doc[1]) // enc.width + 1)
                    if len(held) >= 2 * DOCS_AT_ONCE or len(doc[1]) > READ_BYTES:
                        out.write(b"".join(held))
                        held = []
                    doc = next(encoded, None)
                out.write(b"".join(held))
                out.write(np.array(bounds, "<u8").tobytes())
                out.write(struct.pack(FOOTER, len(keys), bounds[-1], enc.width, MAGIC))

            into_place(folder, shard_name(shard), body)
            n = len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.full(n, shard)), pa.array(np.arange(n)), pa.array(np.diff(bounds))], names=["doc_id", "shard", "ordinal", "n_tokens"])
            shard += 1

    text = F.coalesce(F.col(text_col), F.lit(""))
    # The last two part rows of one key, however many they are; equal texts are told apart only to be dealt.
    order = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("one")]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("one"))
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size > 1 << 60:  # the planner doesn't know
        size = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long") + 16)).first()[0] or 0
    tasks = max(1, -(-size // TASK_BYTES), min(LEAST_TASKS, -(-size // TASK_LEAST)))
    dealt = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("doc_id", "text")
    entries = materialize(dealt.mapInArrow(encode, "doc_id long, shard long, ordinal long, n_tokens long"), "token-entries")

    # One row a shard: its first id is the number of ids in the shards before it.
    totals = entries.groupBy("shard").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs"))
    shards = materialize(running(totals, "shard", F.col("n"), "first_id", "token-totals").select("shard", "docs", "first_id"), "token-shards")

    spans = entries.groupBy("doc_id", "shard").agg(F.min("ordinal").alias("ordinal"), F.count("*").alias("rows"))
    first = spans.groupBy("doc_id").agg(F.min(F.struct("shard", "ordinal", "rows")).alias("at"), F.array_sort(F.collect_list(F.struct("shard", "ordinal", "rows"))).alias("every"))
    places = materialize(first.select("doc_id", "at", F.when(F.col("doc_id").isNull(), F.col("every")).otherwise(F.expr("slice(every, 2, size(every))")).alias("more")), "token-places")
    beside = places.where(F.size("more") > 0).select("doc_id", F.explode("more").alias("m")).select("doc_id", "m.shard", "m.ordinal", "m.rows")
    indexed = places.where("doc_id is not null")
    buckets = max(1, -(-indexed.count() // INDEX_KEYS))
    keyed = indexed.select(F.pmod(F.xxhash64("doc_id", F.lit("bucket")), F.lit(buckets)).cast("int").alias("bucket"), F.xxhash64("doc_id").alias("h"), "at.shard", "at.ordinal", "at.rows")

    def index(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        raw = index_bytes(pdf["h"].to_numpy(np.int64).view(np.uint64), *(pdf[c].to_numpy(np.int64) for c in ("shard", "ordinal", "rows")))
        into_place(folder, index_name(int(key[0])), lambda out: out.write(raw))
        return pd.DataFrame({"bucket": [key[0]], "n_bytes": [len(raw)]})

    materialize(keyed.groupBy("bucket").applyInPandas(index, "bucket int, n_bytes long"), "token-index")
    return TokenStore(spark, folder, buckets, shards, beside)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return write(docs).read(docs.select("doc_id"), with_ids=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_token_store": op1_token_store}
SQL: dict[str, str] = {}
