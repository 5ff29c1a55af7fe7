import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from spanloom.llm import encoding, packing, token_counts, token_store
from spanloom.llm.encoding import Encoder
from tests.llm.data import documents

ODD = ["a", "  ", " ", "\n", "é", "é", " ́", "ñ", "the", "The ", "'s ", "　", "漢字", "</s>", "<s>", "<0x0A>", "<|endoftext|>", "\t", "😀", "İ", "Σ", "\u0085", "\x1c", "123", "...", "\x00", "ing", "▁", " ", "ﬁ"]


def strings(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choices(ODD, k=rng.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("entries", [1_000_000, 700])
def test_remembered_words_change_nothing(name, entries):
    enc, plain = Encoder(str(P.path(name)), entries), Tokenizer.from_file(str(P.path(name)))
    texts = strings(1, 3000) + ["", "a b c " * 50]
    want = [np.array(x.ids, "<u2").tobytes() for x in plain.encode_batch(texts, add_special_tokens=False)]
    got = [raw for i in range(0, len(texts), 500) for raw in enc.encode(texts[i : i + 500])]
    assert got == want and [enc._long(t) for t in texts] == want


LETTERS = "aZéßİıŞĞÜÇÖΣςÅſǅŉĲﬁﬀ̈́क़གྷẞ가가İͅΐｱﾞДй漢ªµKΩ𐐀Ώ̇"


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_signs_after_any_letter(name):
    enc, plain = Encoder(str(P.path(name)), 20_000), Tokenizer.from_file(str(P.path(name)))
    rng = random.Random(11)
    every = [c for c in map(chr, range(0x21, 0x3000)) if c.isalpha()]
    texts = [f"{stem}{c}{e} {e}{c}" for c in LETTERS for e in ".,;:!?" for stem in ("", "x", "KAYSER")]
    texts += [" ".join("".join(rng.choices([*LETTERS, *every, "'s", "'LL", ".", ",", "1", "-"], k=rng.randint(1, 5))) + rng.choice([*".,;:!?", "..", ""]) for _ in range(rng.randint(1, 8))) for _ in range(20_000)]
    texts += ["ŞEHRİ, ANKARA", "KAYSERİ. foo", "İ. x", "don't. we'll, I'd;"]
    want = [np.array(x.ids, "<u2").tobytes() for x in plain.encode_batch(texts, add_special_tokens=False)]
    got = [raw for i in range(0, len(texts), 1000) for raw in enc.encode(texts[i : i + 1000])]
    assert [t for t, a, b in zip(texts, got, want, strict=True) if a != b] == []


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_the_table_is_bounded_in_bytes(name):
    enc, rng = Encoder(str(P.path(name)), 2000), random.Random(3)
    held = lambda: sum(4 * len(w) + len(x) for w, x in enc.words.items())
    for n in (4000, 60, 500):  # texts without a blank, short ones and long ones
        texts = ["".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(n)) for _ in range(300)]
        enc.encode(texts)
        assert held() == enc.held <= 64 * 2000 + 300 * 4 * 64 * 3 and all(len(w) <= 64 for w in enc.words) and all(len(w) <= 64 for w in enc.heads)
    enc.encode([" ".join(f"{rng.getrandbits(64):x}" for _ in range(50)) for _ in range(400)])
    assert held() == enc.held


def test_long_texts_are_cut_into_parts(monkeypatch):
    monkeypatch.setattr(encoding, "AT_ONCE", 50)
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        enc, plain = Encoder(str(P.path(name))), Tokenizer.from_file(str(P.path(name)))
        texts = [" ".join(f"w{i % 7} thing{i}, {'x' * (i % 90)}y" for i in range(n)) for n in (0, 1, 5, 100)] + ["a  b " * 60, "漢" * 400, " lead " + "word. " * 40]
        assert enc.encode(texts) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]


def test_counts_agree_with_the_library():
    sp = sentencepiece.SentencePieceProcessor(model_file=str(P.path("piece_bpe_32k.model")))
    counter = token_counts.PieceCounter(str(P.path("piece_bpe_32k.model")), cache_entries=500)
    for t in [*strings(2, 6000), "", "internationalisation of merges " * 40]:
        assert counter.count(t) == len(sp.encode(t)), t


def test_counts_of_a_table(spark):
    docs = documents(spark)
    rows = token_counts.token_counts(docs).collect()
    assert len(rows) == docs.count() and {(r.n_bytes, r.n_tokens) for r in rows if r.doc_id in (200, 204)} == {(0, 0)}
    assert [r.over_limit for r in rows if r.doc_id == 103] == [True] and token_counts.token_counts(docs.where("false")).count() == 0


def test_perfect_hash():
    for n in (0, 1, 2, 5000):
        keys = np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64)
        mph = token_store.PerfectHash.build(keys)
        assert sorted(mph.slots(keys).tolist()) == list(range(n))
        index = token_store.Index(token_store.index_bytes(keys, keys % 7, keys % 11, keys % 3))
        place, there = index.find(keys)
        opened = token_store.OpenIndex(pa.BufferReader(token_store.index_bytes(keys, keys % 7, keys % 11, keys % 3)))
        assert all(opened.find(int(k)) == (k % 7, k % 11, k % 3) and opened.find(int(k) + 1) is None for k in keys[:200])
        assert there.all() and (place["ordinal"] == keys % 11).all() and not index.find(keys + np.uint64(1))[1].any()


def test_store_gives_back_every_row(spark):
    docs = documents(spark)
    t = Tokenizer.from_file(str(P.path("word_bpe_49k.json")))
    store = token_store.write(docs, shard_docs=7)
    assert all(store.get(k) is None for k in (999, -5, 1 << 62)) and store.shards.count() > 1
    rows = sorted((r for r in store.read(docs).collect()), key=lambda r: r.start)
    key = lambda t: xxhash.xxh64_intdigest(t.encode(), 42)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    order = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, signed(key(x[1]))))
    at = 0
    assert len(rows) == len(order)
    for r, (doc_id, text) in zip(rows, order, strict=True):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) == (doc_id, at, len(ids), zlib.crc32(ids), ids.tobytes())
        at += len(ids)
        if doc_id is not None and (doc_id < 300 or text == next(x for i, x in order if i == 300)):
            assert (store.get(doc_id) == ids).all()
    assert store.read(spark.createDataFrame([(999,), (103,)], "doc_id long")).count() == 1
    empty = docs.where("false")
    assert token_store.write(empty).read(docs).count() == 0


def test_equal_keys_over_several_shards(spark):
    docs = spark.createDataFrame([(k, f"text {i % 5}") for k in (None, 1, 2) for i in range(40)] + [(9, "x")], "doc_id long, text string")
    store = token_store.write(docs, shard_docs=6)
    assert store.beside.where("doc_id = 2").count() > 1
    rows = sorted(store.read(docs).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None] * 40 + [1] * 40 + [2] * 40 + [9]
    assert all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:], strict=False)) and rows[0].start == 0
    assert store.read(docs.where("doc_id = 2")).count() == 40 and store.read(docs.where("doc_id is null")).count() == 40


def test_neighbours_come_with_one_read(spark, monkeypatch):
    docs = spark.range(300).selectExpr("id as doc_id", "concat('word ', id) as text").coalesce(1)
    monkeypatch.setattr(token_store, "LEAST_TASKS", 1)
    store = token_store.write(docs)
    shard = token_store.Shard(store.folder, 0)
    reads = []
    monkeypatch.setattr(shard, "ids", lambda a, b: reads.append((a, b)) or token_store.Shard.ids(shard, a, b))
    found = list(shard.documents(np.array([0, 1, 2, 50, 299])))
    assert len(reads) == 1 and [k for k, *_ in found] == [0, 1, 2, 50, 299] and all((ids == store.get(k)).all() for k, _, ids in found)
    monkeypatch.setattr(token_store, "READ_GAP", 0)
    assert len(list(shard.documents(np.array([0, 1, 2, 50, 299])))) == 5 and len(reads) == 4


def checked_pieces(rows, docs):
    """Every id of every document in exactly one piece, sequences gapless and within capacity; the padded share."""
    t = Tokenizer.from_file(str(P.path("byte_bpe_50k.json")))
    want = sorted(np.array([*t.encode(x.text or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for x in docs.collect())
    sequences, texts = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
        assert r.length * 4 == len(r.ids) and zlib.crc32(r.ids) == r.ids_crc32
    padded = total = 0
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        total, padded = total + at, padded + (0 if at & (at - 1) == 0 else 1024 - at)
    for r in rows:
        texts.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for (_, n), rs in texts.items():
        assert sum(r.length for r in rs) % n == 0
    one = [b"".join(r.ids for r in sorted(rs, key=lambda r: r.start)) for rs in texts.values() if sum(r.length for r in rs) == rs[0].doc_tokens]
    assert set(one) <= set(want) and sum(map(len, want)) == 4 * total
    return padded / total


def test_packing(spark):
    docs = documents(spark)
    assert checked_pieces(packing.pack(docs).collect(), docs) < 0.01
    assert packing.pack(docs.where("false")).count() == 0


def test_differencing_is_near_equal():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 200, 900).tolist()
    parts = packing.differencing(sizes, 60)
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert sorted(i for p in parts for i in p) == list(range(900)) and max(sums) - min(sums) <= 2
    assert all(sum(sizes[i] for i in p) <= 500 for p in packing.windows(sizes, 500))
    assert len(packing.windows([400, 400, 400], 500)) == 3 and packing.pack_tails([]) == []
    assert [sum(n for *_, n in s) for s in packing.pack_tails([(0, 0, 300)])] == [256, 32, 8, 4]
