"""Quality rules in DataFrame expressions alone: counted base rules, then distribution divergence.

Every document's histogram over character classes and over the common words of its language is compared with the
reference of that language by Jensen-Shannon distance (root of the divergence, base 2); the words are compared twice,
one by one and as common against others, which tells a text without common words from a short one. A test applies only
from a minimum length on, and its limit is widened by the distance that sampling alone gives a text of that length.

The references are the histograms of all documents that pass the base rules and the guards, by whatever ``lang`` says:
one row a language, written and joined. They are fitted twice: first the middle of each bin, which junk doesn't shift
while it is less than half, then the mean of the documents near that. Both are worked out from whole numbers (counts of
fine buckets, sums of rounded shares), so reruns agree to the bit. Other references can be handed in.

Defined cases: a null text counts as empty (no words, so the base rules reject it); a null language is a language; one
of fewer than MIN_DOCS such documents has no reference, so its documents are tested by the base rules alone, and one
that isn't listed below has no word test; a null id is kept as it is; repeated rows are judged alike, each on its own;
repeated windows are told by 64-bit hash; an empty table gives no rows; further columns of any name are ignored
(``rules``) or kept (``keep``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.common import let, materialize, table, words

#: The most common words of each language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "as", "on"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un"],
}
#: What stands for a null language.
UNKNOWN = "*"
CHAR_CLASSES = ["small", "space", "upper", "point", "digit", "other"]
WINDOW = 5
MIN_WORDS = 10
#: Guards: characters and words from which the two tests apply.
MIN_CHARS_TESTED = 150
MIN_WORDS_TESTED = 40
#: Largest distances from the reference.
MAX_CHAR_DISTANCE = 0.14
MAX_WORD_DISTANCE = 0.18
#: Of these limits, what counts as far for the second fit of the references.
FIRST_FIT = 0.75
#: Documents that a reference needs; buckets of a share for its middle; parts of a share for its mean.
MIN_DOCS = 20
FINE, PARTS = 4096, 1 << 24


def repeated_words(w: Column, window: int = WINDOW) -> Column:
    """How many words of the array lie in windows that the array holds twice or more.

    Windows are compared by 64-bit hash; the sorted places of repeated ones give the covered words.
    """
    starts = F.sequence(F.lit(0), F.size(w) - window)
    hashed = lambda a: F.transform(starts, lambda i: F.xxhash64(*[F.get(a, i + k) for k in range(window)]))

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(p: Column) -> Column:
            same = lambda i, j: F.get(p, i)["h"] == F.get(p, j)["h"]
            twice = F.filter(p, lambda x, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
            return F.array_sort(F.transform(twice, lambda x: x["i"]))

        def length(at: Column) -> Column:
            steps = F.transform(at, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(at, i + 1) - x, F.lit(window))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return let(let(pairs, places), length)

    def guarded(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0)

    return F.when(F.size(w) > window, let(let(w, hashed), guarded)).otherwise(0).cast("long")


def class_counts(text: Column) -> list[Column]:
    """Characters of each class. The long runs of small letters and blanks go first, the rest is short."""
    rest = F.regexp_replace(text, r"[\p{Ll} ]+", "")

    def counts(r: Column) -> Column:
        gone = lambda pattern: F.length(r) - F.length(F.regexp_replace(r, pattern, ""))
        upper, point, space, digit = gone(r"\p{Lu}+"), gone(r"[.,;:!?'\"()¿¡«»-]+"), gone(r"[\t-\r]+"), gone(r"\p{N}+")
        return F.struct(F.length(r).alias("all"), upper.alias("upper"), point.alias("point"), space.alias("space"), digit.alias("digit"))

    return let(rest, counts)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: Sequence[str] = ()) -> DataFrame:
    """One row per document: the base counts and both histograms, in one pass over the texts; ``carry`` are columns kept."""
    every = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), *carry)

    def of_words(w: Column) -> Column:
        common = F.filter(w, lambda x: x.isin(every))

        def histogram(c: Column) -> Column:
            def k_th(k: int) -> Column:
                word = F.lit(None).cast("string")
                for lang, ws in COMMON_WORDS.items():
                    word = F.when(F.col("lang") == lang, F.lit(ws[k])).otherwise(word)
                return F.coalesce(F.size(c) - F.size(F.array_remove(c, word)), F.lit(0))

            return F.array(*[k_th(k) for k in range(len(COMMON_WORDS["en"]))])

        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
            let(common, histogram).alias("common"),
        )

    def of_lines(lines: Column) -> Column:
        return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")

    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    rows = rows.select(
        "doc_id",
        "lang",
        F.length("text").cast("long").alias("n_chars"),
        F.length(F.replace("text", F.lit(" "), F.lit(""))).cast("long").alias("n_unspaced"),
        class_counts(F.col("text")).alias("c"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines, of_lines).alias("n_dup_lines"),
        let(words(F.col("text")), of_words).alias("w"),
        *carry,
    )
    blanks = F.col("n_chars") - F.col("n_unspaced")
    rest = F.col("c.all") - F.col("c.upper") - F.col("c.point") - F.col("c.space") - F.col("c.digit")
    chars = F.array(F.col("n_unspaced") - F.col("c.all"), blanks + F.col("c.space"), F.col("c.upper"), F.col("c.point"), F.col("c.digit"), rest)
    return rows.select(
        "doc_id", "lang", "n_chars", "w.n_words", "w.word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words",
        F.transform(chars, lambda x: x.cast("double")).alias("chars"), F.transform("w.common", lambda x: x.cast("double")).alias("common"), *carry,
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _shares(rows: DataFrame) -> DataFrame:
    """Adds both histograms as shares, the words with a last bin for all others."""
    common = F.transform("common", lambda x: x / F.greatest(F.col("n_words"), F.lit(1)))
    return rows.withColumns({
        "p_chars": F.transform("chars", lambda x: x / F.greatest(F.col("n_chars"), F.lit(1))),
        "p_words": let(common, lambda c: F.concat(c, F.array(F.greatest(1 - _sum(c), F.lit(0.0))))),
    })


def _fit(rows: DataFrame, middle: bool) -> DataFrame:
    """(lang, qc, qw) by the middle or the mean of every bin; a row for every language that has enough documents."""
    nc = len(CHAR_CLASSES)
    enough = ~base_failed() & (F.col("n_chars") >= MIN_CHARS_TESTED) & (F.col("n_words") >= MIN_WORDS_TESTED)
    shares = rows.where(enough).select("lang", F.concat("p_chars", "p_words").alias("p"))
    if middle:
        counts = shares.select("lang", F.posexplode(F.transform("p", lambda x: F.floor(x * FINE).cast("int")))).groupBy("lang", "pos", "col").agg(F.count("*").alias("n"))
        bin_ = Window.partitionBy("lang", "pos")
        upto = counts.select("lang", "pos", "col", F.sum("n").over(bin_.orderBy("col")).alias("upto"), F.sum("n").over(bin_).alias("n"))
        bins = upto.where("2 * upto >= n").groupBy("lang", "pos").agg(F.min("col").alias("col"), F.max("n").alias("n"))
        values = bins.groupBy("lang").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "col"))).alias("v"))
        values = values.select("lang", "n", F.transform("v", lambda x: x["col"] + 0.5).alias("v"))
    else:
        sums = F.array(*[F.sum(F.floor(F.col("p")[i] * PARTS)).cast("double") for i in range(nc + len(COMMON_WORDS["en"]) + 1)])
        values = shares.groupBy("lang").agg(F.count("*").alias("n"), sums.alias("v"))
    part = lambda first, n: let(F.slice("v", first, n), lambda xs: F.transform(xs, lambda x: F.round(x / _sum(xs), 9)))
    listed = F.col("lang").isin(list(COMMON_WORDS))
    return values.where(F.col("n") >= MIN_DOCS).select("lang", part(1, nc).alias("qc"), F.when(listed, part(nc + 1, len(COMMON_WORDS["en"]) + 1)).alias("qw"))


def references(rows: DataFrame) -> DataFrame:
    """(lang, qc, qw) over all documents of ``features``, one row a language: the mean of the documents near the
    middle; where too few are near, the middle stands."""
    rows = _shares(rows)
    first = materialize(_fit(rows, middle=True), "quality-middle")
    second = _fit(_tested(rows, first).where(~_far(FIRST_FIT)), middle=False).select("lang", F.col("qc").alias("mc"), F.col("qw").alias("mw"))
    return materialize(first.join(second, "lang", "left").select("lang", F.coalesce("mc", "qc").alias("qc"), F.coalesce("mw", "qw").alias("qw")), "quality-references")


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares; null if either is."""

    def part(a: Column, b: Column) -> Column:
        side = lambda x: F.when(x > 0, x * F.log2(2 * x / (a + b))).otherwise(0.0)
        return side(a) + side(b)

    return F.sqrt(F.greatest(_sum(F.zip_with(p, q, part)) / 2, F.lit(0.0)))


def by_chance(bins: int, n: Column) -> Column:
    """The distance that a sample of n from the reference itself has, about."""
    return F.sqrt(F.lit((bins - 1) / (8 * math.log(2))) / F.greatest(n, F.lit(1)))


def _tested(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """Adds the distances of both histograms and of the common words together; null where a guard holds."""
    rows = rows.join(refs, "lang", "left")
    long = (F.col("n_words") >= MIN_WORDS_TESTED) & F.col("qw").isNotNull()
    split = lambda q: F.array(1 - F.element_at(q, -1), F.element_at(q, -1))
    return rows.withColumns({
        "char_distance": F.when((F.col("n_chars") >= MIN_CHARS_TESTED) & F.col("qc").isNotNull(), distance(F.col("p_chars"), F.col("qc"))),
        "word_distance": F.when(long, distance(F.col("p_words"), F.col("qw"))),
        "common_distance": F.when(long, distance(split(F.col("p_words")), split(F.col("qw")))),
    })


def _far(widen: float = 1.0) -> Column:
    over = lambda c, most, bins, n: F.coalesce(F.col(c) > widen * most + by_chance(bins, F.col(n)), F.lit(False))
    far_c = over("char_distance", MAX_CHAR_DISTANCE, len(CHAR_CLASSES), "n_chars")
    return far_c | over("word_distance", MAX_WORD_DISTANCE, len(COMMON_WORDS["en"]) + 1, "n_words") | over("common_distance", MAX_WORD_DISTANCE, 2, "n_words")


def judged(rows: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """``features`` with the distances (null where a guard holds) and the verdict ``kept``."""
    refs = references(rows) if refs is None else refs
    tested = _tested(_shares(rows), refs)
    return tested.select("*", base_failed().alias("base_failed"), (~base_failed() & ~_far()).alias("kept")).drop("p_chars", "p_words", "qc", "qw")


def rules(docs: DataFrame, refs: DataFrame | None = None, **cols: str) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distances) a document."""
    rows = materialize(features(docs, **cols), "quality")
    return judged(rows, refs).drop("chars", "common", "lang", "n_chars")


def keep(docs: DataFrame, refs: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents that the rules keep, with all their columns.

    The documents are written beside their features, so that one pass over the texts serves references and verdicts.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    named = docs.select(row, F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = materialize(features(named, carry=["row"]), "quality")
    return judged(rows, refs).where("kept").select("row.*")


CONTRACT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(table(spark, sf_dir, "documents")).select(*CONTRACT)


def _sql() -> str:
    """The rules and both fits of the references for DuckDB."""
    nc, nw = len(CHAR_CLASSES), len(COMMON_WORDS["en"]) + 1
    lists = " ".join(f"WHEN '{lang}' THEN {ws}" for lang, ws in COMMON_WORDS.items())
    langs = ", ".join(f"'{lang}'" for lang in COMMON_WORDS)
    share = lambda xs: f"list_transform({xs}, lambda x: round(x / list_sum({xs}), 9))"
    bins = lambda p, n, f: share("[" + ", ".join(f.format(f"{p}[{i + 1}]") for i in range(n)) + "]")
    side = lambda x: f"(CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / (z[1] + z[2])) ELSE 0 END)"
    js = lambda p, q: f"sqrt(greatest(list_sum(list_transform(list_zip({p}, {q}), lambda z: {side('z[1]')} + {side('z[2]')})) / 2, 0))"
    split = lambda q: f"[1 - {q}[{nw}], {q}[{nw}]]"
    chance = lambda bins, n: f"sqrt({(bins - 1) / (8 * math.log(2))!r} / greatest({n}, 1))"
    enough = f"NOT base_failed AND n_chars >= {MIN_CHARS_TESTED} AND n_words >= {MIN_WORDS_TESTED}"
    middle = f"list_sort(list(CAST(floor({{0}} * {FINE}) AS INTEGER)))[(count(*) + 1) // 2] + 0.5::DOUBLE"
    mean = f"CAST(sum(CAST(floor({{0}} * {PARTS}) AS BIGINT)) AS DOUBLE)"

    def fit(name: str, rows: str, where: str, f: str) -> str:
        return f"""{name} AS (
  SELECT lang, {bins("pc", nc, f)} AS qc, CASE WHEN lang IN ({langs}) THEN {bins("pw", nw, f)} END AS qw FROM {rows} WHERE {where} GROUP BY lang HAVING count(*) >= {MIN_DOCS})"""

    def far(name: str, refs: str, widen: float) -> str:
        long = f"n_words >= {MIN_WORDS_TESTED} AND r.qw IS NOT NULL"
        return f"""{name} AS (
  SELECT f.*, coalesce((CASE WHEN n_chars >= {MIN_CHARS_TESTED} AND r.qc IS NOT NULL THEN {js("pc", "r.qc")} END) > {widen * MAX_CHAR_DISTANCE!r} + {chance(nc, "n_chars")}, FALSE)
    OR coalesce((CASE WHEN {long} THEN {js("pw", "r.qw")} END) > {widen * MAX_WORD_DISTANCE!r} + {chance(nw, "n_words")}, FALSE)
    OR coalesce((CASE WHEN {long} THEN {js(split("pw"), split("r.qw"))} END) > {widen * MAX_WORD_DISTANCE!r} + {chance(2, "n_words")}, FALSE) AS far
  FROM f LEFT JOIN {refs} r ON r.lang = f.lang)"""

    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(lang, '{UNKNOWN}') AS lang FROM documents),
w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
         regexp_replace(t, '[\p{{Ll}} ]+', '', 'g') AS r, len(replace(t, ' ', '')) AS unspaced, coalesce(CASE lang {lists} END, list_transform(range({nw - 1}), lambda x: '')) AS cw
  FROM d
), win AS (SELECT rid, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) > {WINDOW})),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM dup) GROUP BY rid),
k AS (
  SELECT w.*, len(t) AS n_chars, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: len(x))), 0) AS BIGINT) AS word_chars,
         len(t) - len(translate(t, '#*$%&|<>', '')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         len(r) - len(regexp_replace(r, '\p{{Lu}}+', '', 'g')) AS up, len(r) - len(regexp_replace(r, '[.,;:!?''"()¿¡«»-]+', '', 'g')) AS po, len(r) - len(regexp_replace(r, '[\t-\r]+', '', 'g')) AS bl, len(r) - len(regexp_replace(r, '\p{{N}}+', '', 'g')) AS di,
         list_transform(cw, lambda c: len(list_filter(ws, lambda x: x = c)) / greatest(len(ws), 1)) AS hist
  FROM w LEFT JOIN rep USING (rid)
), f AS (
  SELECT rid, doc_id, lang, n_chars, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
         n_words < {MIN_WORDS} OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         list_transform([unspaced - len(r), n_chars - unspaced + bl, up, po, di, len(r) - up - po - bl - di], lambda x: x / greatest(n_chars, 1)) AS pc,
         list_append(hist, greatest(1 - list_sum(hist), 0)) AS pw
  FROM k
), {fit("q1", "f", enough, middle)}, {far("f1", "q1", FIRST_FIT)}, {fit("q2", "f1", enough + " AND NOT far", mean)},
q3 AS (SELECT q1.lang, coalesce(q2.qc, q1.qc) AS qc, coalesce(q2.qw, q1.qw) AS qw FROM q1 LEFT JOIN q2 ON q2.lang = q1.lang), {far("f2", "q3", 1.0)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT far AS kept FROM f2
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op6_quality_rules": op6_quality_rules}
SQL = {"op6_quality_rules": _sql()}
