import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from spanloom.llm import mixing, near_dedup, quality
from spanloom.llm.common import materialize
from tests.llm.data import documents
from tests.llm.test_tokens import checked_pieces


def test_stages(spark):
    docs = documents(spark)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "source mix", "packing"]
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(materialize(stage(spark, seen[-1], ""), "test"))
        if name != "packing":
            assert seen[-1].columns == docs.columns
    _, good, single, taken, _ = (x.count() for x in seen)
    assert good == quality.rules(docs).where("kept").count()
    classes = near_dedup.classes(seen[1].where("doc_id <> 300")).select("class_id").distinct()
    assert seen[2].where("doc_id <> 300").count() == classes.count() and single > classes.count()
    assert taken == mixing.mix(seen[2]).agg({"copies": "sum"}).first()[0]
    assert checked_pieces(seen[4].collect(), seen[3]) < 0.05


def test_run(spark, tmp_path):
    documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"] and out.count() > 0
    # Every copy of every document that the mix took comes back whole from the ids.
    pieces = {}
    for r in out.collect():
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    text = {r.doc_id: r.text for r in documents(spark).collect()}
    decode = Tokenizer.from_file(str(P.path("byte_bpe_50k.json"))).decode
    for (doc_id, n), rs in pieces.items():
        at = [0] * n
        for r in rs:
            at[r.start : r.start + r.length] = np.frombuffer(r.ids, "<u4").tolist()
        assert sum(r.length for r in rs) % n == 0 and at[-1] == 0
        assert doc_id == 300 or decode(at[:-1], skip_special_tokens=False) == text[doc_id]
