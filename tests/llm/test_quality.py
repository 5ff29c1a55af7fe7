import random
import re

from pyspark.sql import functions as F

from spanloom.llm import quality
from tests.llm.data import SCHEMA, documents, row

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts_agree_with_brute_force(spark):
    odd = ["a b c d e a b c d e", "a a a a a a a", "x\ny\nx\n\n \nx", "a b c d e f\r\na b c d e", "# * <p> |é ü 漢字 ", "\n", "a b c d a b c d a b c", "\x0b\x0ca\x1cb  c", "w " * 30]
    docs = spark.createDataFrame([row(i, t) for i, t in enumerate(odd)], SCHEMA).unionByName(documents(spark).where("doc_id is not null and doc_id >= 20 and doc_id < 300"))
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.rules(docs).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == brute(r.text), r.text


def test_verdicts_and_edges(spark):
    docs = documents(spark)
    found = quality.rules(docs)
    assert found.count() == docs.count()
    for r in found.where("doc_id is null or doc_id in (200, 201, 202, 204)").collect():
        assert r.base_failed and not r.kept
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and kept.count() == found.where("kept").count() > 0
    assert quality.rules(docs.where("false")).count() == 0 and quality.keep(docs.where("false")).count() == 0


def test_divergence_tells_junk_from_prose(spark):
    rng = random.Random(4)
    syllables = ["ba", "lo", "ti", "ne", "ru", "sha"]
    word = lambda: rng.choice(quality.COMMON_WORDS["en"]) if rng.random() < 0.4 else "".join(rng.choices(syllables, k=3))
    text = [". ".join(" ".join([word().capitalize(), *(word() for _ in range(11))]) for _ in range(25)) for _ in range(30)]
    junk = [" ".join(w.upper() + "!!" for w in t.split()) for t in text[:3]] + ["### ".join(t.split()) for t in text[3:6]]
    rows = [row(i, t) for i, t in enumerate(text)] + [row(100 + i, t) for i, t in enumerate(junk)]
    found = {r.doc_id: r for r in quality.rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(found[i].kept for i in range(30)) and not any(found[100 + i].kept for i in range(6))
    assert not any(found[100 + i].base_failed for i in range(6))


def english(seed, n_words):
    rng = random.Random(seed)
    syllables = ["ba", "lo", "ti", "ne", "ru", "sha"]
    word = lambda: rng.choice(quality.COMMON_WORDS["en"]) if rng.random() < 0.4 else "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    return " ".join(w.capitalize() if i % 12 == 0 else w + "." if i % 12 == 11 else w for i, w in enumerate(word() for _ in range(n_words)))


def test_numbers_and_texts_without_common_words_are_told(spark):
    rng = random.Random(9)
    bare = lambda n: " ".join("".join(rng.choices(["ba", "lo", "ti", "ne"], k=3)) for _ in range(n))
    numbers = lambda n: " ".join(str(rng.randint(10**4, 10**7)) for _ in range(n))
    rows = [row(i, english(i, 45 + 20 * i)) for i in range(40)]
    rows += [row(100, numbers(60)), row(101, numbers(2000)), row(102, bare(40)), row(103, bare(100)), row(104, bare(190))]
    found = {r.doc_id: r for r in quality.rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [i for i in range(40) if not found[i].kept] == [] and not any(found[i].kept or found[i].base_failed for i in range(100, 105))


def test_every_language_has_its_own_reference(spark):
    rng = random.Random(5)
    han = lambda n: "。".join(" ".join("".join(chr(rng.randint(0x4E00, 0x5E00)) for _ in range(3)) for _ in range(9)) for _ in range(n))
    rows = [row(i, english(i, 200)) for i in range(30)] + [row(100 + i, han(12), lang="zh") for i in range(30)] + [row(200, han(12), lang="zh-few"), row(201, han(12)), row(202, english(202, 200), lang="zh"), row(203, english(3, 200), lang=None)]
    found = {r.doc_id: r.kept for r in quality.rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(found[i] for i in [*range(30), *range(100, 130), 200, 203]) and not found[201] and not found[202]


def test_reruns_agree_in_any_order(spark):
    rows = [row(i, english(i, 40 + i)) for i in range(60)] + [row(100 + i, english(i, 50).upper()) for i in range(9)]
    docs = spark.createDataFrame(rows, SCHEMA)
    one, other = (quality.references(quality.features(d)).collect() for d in (docs, docs.repartition(9)))
    assert one == other and len(one) == 1 and len(one[0].qc) == 6 and len(one[0].qw) == 13


def test_the_middle_stands_where_too_few_are_near(spark, monkeypatch):
    rows = [row(i, " ".join([["the", "of", "and", "to", "in"][i % 5]] * 20 + [f"y{k}" for k in range(60)])) for i in range(30)]
    docs = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(quality, "MAX_WORD_DISTANCE", 0.01)
    refs = quality.references(quality.features(docs).withColumn("n_repeat_words", F.lit(0).cast("long"))).collect()
    assert [r.lang for r in refs] == ["en"]


def test_distance_is_jensen_shannon(spark):
    p = F.array(F.lit(0.5), F.lit(0.5), F.lit(0.0))
    q = F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))
    assert spark.range(1).select(quality.distance(p, q), quality.distance(p, p)).first() == (1.0, 0.0)


def test_the_plan_has_no_python(spark):
    plan = quality.rules(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
