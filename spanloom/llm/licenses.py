"""Licence scan: passages against licence templates by the Dice coefficient over word bigrams.

A passage is a line, a block of lines between blank ones, the whole text, or a run of words anywhere in it, of up to
(2-t)/t times a template's words; a run that is far shorter than a longer template's match around it is a part of that.
A passage is lower-cased and reduced to its words of letters and digits; its bigrams are a set. Dice is twice the shared bigrams over
all of both. For a limit t a template of b bigrams can only match a passage of t/(2-t)*b to (2-t)/t*b of them, which
prunes nearly all templates before any bigram is compared. A match shares at least t/(2-t)*b bigrams, so a text is only
compared with templates of which it holds one of a few words, and is only cut if it holds that many of their bigrams.

Defined cases: a null or empty text has no passage and no licence; of equal scores the first name in order wins;
repeated rows are scanned each; a null id stays null; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from importlib.resources import files

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import table

#: Notices and headers by name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "LGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}
#: The complete texts, a file each.
TEMPLATES |= {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in sorted(files(__package__).joinpath("license_texts").iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}
LIMIT = 0.8
_WORD = regex.compile(r"[\p{L}\p{N}]+")


def bigrams(text: str) -> set[tuple[str, str]]:
    words = _WORD.findall(text.lower())
    return set(zip(words, words[1:], strict=False))


def passages(text: str) -> set[str]:
    """The lines, the blocks between blank lines and the whole, each once."""
    found, block = {text}, []
    for line in text.split("\n"):
        if line.strip(" \t\r\x0b\x0c"):
            found.add(line)
            block.append(line)
        else:
            found.add("\n".join(block))
            block = []
    found.add("\n".join(block))
    return found


class Scanner:
    """Scores lines, blocks and the whole; with ``runs``, runs of words as well."""

    def __init__(self, templates: dict[str, str], limit: float = LIMIT, runs: bool = False):
        self.limit, self.runs = limit, runs
        self.templates = [(name, bigrams(text)) for name, text in sorted(templates.items())]
        self.lengths = {name: len(_WORD.findall(text.lower())) - 1 for name, text in templates.items()}
        self.least = limit / (2 - limit)
        self.anchors: dict[str, list[int]] = {}
        for k, (_, b) in enumerate(self.templates):
            spare = len(b) - math.ceil(self.least * len(b) - 1e-9) + 1
            # Of so many bigrams a match has one at least; a few long words lie in enough of them.
            count = Counter(w for pair in b for w in set(pair))
            left = set(b)
            for w in sorted(count, key=lambda w: (len(w) < 6, -count[w] if len(w) >= 6 else -len(w), w)):
                if len(b) - len(left) >= spare:
                    break
                self.anchors.setdefault(w, []).append(k)
                left = {pair for pair in left if w not in pair}
        self.low = min((self.least * len(b) for _, b in self.templates), default=0) - 1e-9
        self.high = max((len(b) / self.least for _, b in self.templates), default=0) + 1e-9

    def shared(self, words: list[str]) -> list[tuple[str, set[tuple[str, str]], set[tuple[str, str]]]]:
        """(name, its bigrams, those that the words hold) of the templates of which the words hold enough for a match."""
        kinds = {k for w in self.anchors.keys() & set(words) for k in self.anchors[w]}
        if not kinds:
            return []
        held = set(zip(words, words[1:], strict=False))
        rows = ((name, b, b & held) for name, b in map(self.templates.__getitem__, sorted(kinds)))
        return [(name, b, own) for name, b, own in rows if len(own) >= self.least * len(b) - 1e-9]

    def windows(self, words: list[str], kinds: list[tuple[str, set[tuple[str, str]], set[tuple[str, str]]]]) -> dict[str, float]:
        """Each template's best score over the runs of words that begin and end with one of its bigrams.

        Work is in proportion to the text, times the longest template's reach at most.
        """
        pairs = list(zip(words, words[1:], strict=False))
        n = len(pairs)
        at: dict[tuple[str, str], list[int]] = {}
        for i, pair in enumerate(pairs):
            at.setdefault(pair, []).append(i)
        before, after = np.full(n, -1), np.full(n, 2 * n)  # where each bigram stood last, and stands next
        for places in at.values():
            before[places[1:]] = places[:-1]
            after[places[:-1]] = places[1:]
        best: dict[str, float] = {}
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        for name, b, own in sorted(kinds, key=lambda t: -self.lengths[t[0]]):
            hit = np.zeros(n, bool)
            hit[[i for pair in own for i in at[pair]]] = True
            reach = math.ceil(self.lengths[name] / self.least)
            starts = np.flatnonzero(hit)
            ends = np.minimum(starts + reach, n)
            so_far = np.concatenate([[0], np.cumsum(hit)])
            enough = so_far[ends] - so_far[starts] >= self.least * len(b) - 1e-9
            # A run scores more with the bigram before it, if that is the template's too, isn't in the run, and there is room.
            left = np.maximum(starts - 1, 0)
            better = (starts > 0) & hit[left] & (after[left] >= starts + reach) & ~((starts + reach <= n) & hit[ends - 1])
            starts = starts[enough & ~better]
            around = []
            for first, last in taken:
                k = np.maximum(first.searchsorted(starts, "right") - 1, 0)
                around.append((first[k], last[k]))
            found = []
            for i, s in enumerate(starts.tolist()):
                inside = hit[s : s + reach]
                fresh = before[s : s + reach] < s
                score = 2 * np.cumsum(fresh & inside) / (np.cumsum(fresh) + len(b))
                score[~inside] = 0
                for first, last in around:  # what a far longer match holds is a part of it
                    if first[i] <= s <= last[i]:
                        short = math.ceil(self.least * (last[i] - first[i] + 1)) - 1
                        score[: max(0, min(short, last[i] - s + 1))] = 0
                e = len(score) - 1 - int(score[::-1].argmax())
                if score[e] >= self.limit - 1e-9:
                    best[name] = max(best.get(name, 0), float(score[e]))
                    found.append((-float(score[e]), s, s + e))
            busy = np.zeros(n, bool)
            chosen = []
            for _, first, last in sorted(found):
                if not busy[first : last + 1].any():
                    busy[first : last + 1] = True
                    chosen.append((first, last))
            if chosen:
                taken.append(tuple(np.array(c) for c in zip(*sorted(chosen), strict=True)))
        return best

    def scan(self, text: str) -> list[tuple[str, float]]:
        """(template, best score) of every template that a passage matches."""
        words = _WORD.findall(text.lower())
        kinds = self.shared(words)
        if not kinds:
            return []
        best: dict[str, float] = self.windows(words, kinds) if self.runs else {}
        for p in passages(text):
            if len(p) <= self.low:
                continue
            a = bigrams(p)
            n = len(a)
            if not self.low <= n <= self.high:
                continue
            for name, b, _ in kinds:
                if self.least * len(b) - 1e-9 <= n <= len(b) / self.least + 1e-9:
                    score = 2 * len(a & b) / (n + len(b))
                    if score >= self.limit - 1e-9 and score > best.get(name, 0):
                        best[name] = score
        return sorted(best.items())


def scan(docs: DataFrame, templates: dict[str, str] | None = None, limit: float = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, score, licenses, scores): the best match and all of them, one row a document."""
    kinds = dict(templates or TEMPLATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Scanner(kinds, limit, runs=True).scan
        for b in batches:
            found = [find(t) for t in b.column(1).to_pylist()]
            top = [min(f, key=lambda x: (-x[1], x[0])) if f else (None, None) for f in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([n for n, _ in top], pa.string()), pa.array([s for _, s in top], pa.float64()), pa.array([[n for n, _ in f] for f in found], pa.list_(pa.string())), pa.array([[s for _, s in f] for f in found], pa.list_(pa.float64()))],
                names=["doc_id", "license", "score", "licenses", "scores"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, license string, score double, licenses array<string>, scores array<double>")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "license", F.round("score", 6).alias("score"), F.array_join("licenses", ",").alias("licenses"))


def _values() -> str:
    return ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in TEMPLATES.items())


OP8_SQL = rf"""
WITH tpl AS (
  SELECT name, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b
  FROM (SELECT name, regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}]+') AS w FROM (VALUES {_values()}) v(name, body))
), d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
u AS (
  SELECT DISTINCT k, p FROM (
    SELECT k, text AS p FROM d
    UNION ALL SELECT k, unnest(string_split(text, chr(10))) FROM d
    UNION ALL SELECT k, unnest(regexp_split_to_array(text, '\n([ \t\r\v\f]*\n)+')) FROM d)
), g AS (
  SELECT k, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS a
  FROM (SELECT k, regexp_extract_all(lower(p), '[\p{{L}}\p{{N}}]+') AS w FROM u)
), s AS (
  SELECT k, name, max(2.0 * len(list_intersect(a, b)) / (len(a) + len(b))) AS score
  FROM g JOIN tpl ON len(a) * {2 - LIMIT} >= {LIMIT} * len(b) - 0.000001 AND len(b) * {2 - LIMIT} >= {LIMIT} * len(a) - 0.000001
  GROUP BY k, name
), m AS (SELECT k, name, CAST(score AS DOUBLE) AS score FROM s WHERE score >= {LIMIT} - 0.000000001)
SELECT d.doc_id, arg_min(m.name, struct_pack(s := -m.score, n := m.name)) AS license, round(max(m.score), 6) AS score,
       coalesce(string_agg(m.name, ',' ORDER BY m.name), '') AS licenses
FROM d LEFT JOIN m USING (k) GROUP BY d.k, d.doc_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op8_license_scan": op8_license_scan}
SQL = {"op8_license_scan": OP8_SQL}
