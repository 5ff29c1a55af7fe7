"""Documents with everything that a table may hold: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, digest string, kept boolean, word string, copies long"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    words = ["the", "of", "and", "to", "in"] + ["".join(rng.choice(["ba", "lo", "ti", "ne", "ru", "sha"]) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    out = []
    for i in range(n):
        w = rng.choice(words)
        out.append(w.capitalize() + "," if i % 12 == 0 else w + "." if i % 12 == 11 else w)
        if i % 40 == 39:
            out[-1] += "\n"
    return " ".join(out)


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, len(text or ""), 7, "r", "d", False, "w", 9)


def documents(spark):
    base = prose(1, 300)
    near = base.replace(" the ", " THE ", 2)
    rows = [row(i, prose(i, 40 + 13 * i), ["en", "fr", "de", None][i % 4], ["a", "b", None, "Ä", "zz"][i % 5]) for i in range(2, 40)]
    rows += [row(100, base), row(101, base), row(102, near), row(103, prose(103, 20_000)), row(104, base, source="b")]
    rows += [row(None, None), row(None, None), row(None, "a few words"), row(200, ""), row(201, " \n\t "), row(202, "one two three"), row(203, "one two three"), row(204, None, None, None)]
    rows += [row(300, prose(300, 50)), row(300, prose(300, 50)), row(300, prose(301, 50))]
    return spark.createDataFrame(rows, SCHEMA)


def key(r):
    return (r[0] is not None, r[0] if r[0] is not None else 0)
