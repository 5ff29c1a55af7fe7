import random

from spanloom.llm import licenses
from tests.llm.data import documents, prose


def test_scores():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    assert scanner.scan("x\nReleased under the MIT license\ny") == [("MIT", 1.0)]
    assert [n for n, _ in scanner.scan("Licensed under CC BY-NC 4.0.")] == ["CC-BY-NC-4.0"]
    assert scanner.scan(prose(1, 400)) == [] == scanner.scan("") == scanner.scan("license license")
    text = licenses.TEMPLATES["MIT-text"]
    ((name, score),) = scanner.scan("intro\n\n" + text.replace("charge, to", "charge,\nto").replace("Software", "Program", 1) + "\n\nend")
    assert name == "MIT-text" and 0.9 < score < 1


def test_pruning_loses_nothing():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        words = text.split()
        for cut in range(0, len(words) // 3, max(1, len(words) // 30)):
            part = " ".join(words[cut:])
            a = licenses.bigrams(part)
            want = {n: 2 * len(a & b) / (len(a) + len(b)) for n, b in scanner.templates if 2 * len(a & b) >= 0.8 * (len(a) + len(b))}
            assert dict(scanner.scan(part)) == want, name


def test_table(spark):
    docs = documents(spark)
    rows = licenses.scan(docs).collect()
    assert len(rows) == docs.count() and all(r.license is None and r.licenses == [] for r in rows)
    assert licenses.scan(docs.where("false")).count() == 0
    one = licenses.scan(spark.createDataFrame([(1, "Released under the MIT License.\nLicensed under the Apache License, Version 2.0.")], "doc_id long, text string")).first()
    assert (one.license, one.licenses) == ("Apache-2.0", ["Apache-2.0", "MIT"])


ISC = """ISC License

Copyright (c) 2019, Somebody

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""
BSD_2 = """BSD 2-Clause License

Copyright (c) 2019, Somebody

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
COMPLETE = ["Apache-2.0-text", "BSD-2-Clause-text", "BSD-3-Clause-text", "GPL-2.0-text", "GPL-3.0-text", "ISC-text", "LGPL-2.1-text", "LGPL-3.0-text", "MIT-text", "MPL-2.0-text"]


def test_complete_texts():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    best = lambda text: max(scanner.scan(text), key=lambda x: x[1], default=(None, 0))
    for name, text in (("ISC-text", ISC), ("BSD-2-Clause-text", BSD_2)):
        found, score = best(text)
        assert found == name and score > 0.9
    for name in COMPLETE:
        assert best(licenses.TEMPLATES[name]) == (name, 1.0) or name == "MPL-2.0-text"  # which ends with its header
        assert dict(scanner.scan("Copyright (c) 2020 Somebody\n" + licenses.TEMPLATES[name]))[name] > 0.95


def test_within_longer_text():
    scanner = licenses.Scanner(licenses.TEMPLATES, runs=True)
    code = "\n".join(f"def f{i}(x):\n    return x + {i}\n" for i in range(40))
    for name in [*COMPLETE, "Apache-2.0-header", "GPL-3.0-header", "LGPL-3.0-header", "MPL-2.0-header"]:
        text = licenses.TEMPLATES[name]
        assert dict(scanner.scan(prose(1, 300) + "\n\n" + text + code))[name] == 1, name  # several blocks, and code right after
    for text in (ISC, BSD_2):
        assert scanner.scan(prose(2, 300) + "\n\n" + text + "\n\n" + code)
    for name in ("MIT", "CC-BY-4.0", "CC-BY-NC-4.0", "Apache-2.0", "GPL-3.0"):
        assert dict(scanner.scan("eight further words stand here before it all " + licenses.TEMPLATES[name] + " and so on"))[name] == 1
    assert "Apache-2.0" not in dict(scanner.scan("x y\n" + licenses.TEMPLATES["Apache-2.0-header"] + " x"))


def test_windows_are_the_best():
    scanner = licenses.Scanner({"a": "a b c d e f g h", "b": "c d e x"}, runs=True)
    rng = random.Random(3)
    for _ in range(300):
        w = rng.choices("abcdefghx", weights=[1] * 9, k=6) + list("abcdefgh")[: rng.randint(3, 8)] + rng.choices("abcdefghx", k=5)
        b = dict(scanner.templates)["a"]
        pairs = list(zip(w, w[1:]))
        want = max((2 * len(b & set(pairs[i:j])) / (len(b) + len(set(pairs[i:j]))) for i in range(len(pairs)) for j in range(i + 1, min(len(pairs), i + 11) + 1)), default=0)
        assert abs(dict(scanner.scan(" ".join(w))).get("a", 0) - (want if want >= 0.8 - 1e-9 else 0)) < 1e-9


def test_table_finds_what_lies_within(spark):
    rows = [(1, "some words before " + ISC + "\nand words after, of which there are many\n" + prose(3, 400))]
    assert licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).first().license == "ISC-text"


def test_many_copies_and_repeated_words():
    scanner = licenses.Scanner(licenses.TEMPLATES, runs=True)
    text = licenses.TEMPLATES["MIT-text"]
    assert dict(scanner.scan((text + "\n\nwords between copies\n") * 40))["MIT-text"] == 1
    assert scanner.scan("Released under the MIT License.\nand more\n" * 3000) == [("MIT", 1.0)]
    assert scanner.scan("license " * 100_000) == []
    two = licenses.Scanner({"a": "a b c d e f g h", "b": "c d e x"}, runs=True)
    rng = random.Random(5)
    for _ in range(200):  # the words of a template again and again, so that bigrams stand in a run twice
        w = rng.choices("abcdefgh", k=4) + list("abcdefgh")[rng.randint(0, 2) :] * 2 + rng.choices("abcd", k=4)
        b = dict(two.templates)["a"]
        pairs = list(zip(w, w[1:]))
        want = max((2 * len(b & set(pairs[i:j])) / (len(b) + len(set(pairs[i:j]))) for i in range(len(pairs)) for j in range(i + 1, min(len(pairs), i + 11) + 1)), default=0)
        assert abs(dict(two.scan(" ".join(w))).get("a", 0) - (want if want >= 0.8 - 1e-9 else 0)) < 1e-9
