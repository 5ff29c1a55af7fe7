"""Encoding whole texts with the tokenizers library, remembering the ids of words that recur.

A text is cut at U+0020, which no id spans: the library is asked for words it was not asked for before, many in one
call, and a table per worker, bounded in entries and in bytes, keeps its answers. Words too long to recur are not
kept. Whole texts go to the library where a cut could change the result (runs of blanks under a tokenizer that keeps
them).
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of a worker's table.
CACHE_ENTRIES = 1_000_000
#: Bytes of words and ids that the table holds for each of its entries, on average at most.
ENTRY_BYTES = 64
#: Characters of the longest word that is kept.
KEPT_CHARS = 64
#: Signs that often end a word.
ENDS = ".,;:!?"
#: Words that go to the library in one string.
JOINED = 1500
#: Bytes of texts that are turned into arrays at once; a longer text is cut into parts of as many characters.
AT_ONCE = 4_000_000


def ends_alone(letter: str) -> bool:
    """Whether a sign after this letter is a piece of its own, whatever the normaliser does to the letter.

    It has to be one letter still once it is lower case; the scripts above are left to the library.
    """
    return letter < "\u0530" and letter.isalpha() and len(low := letter.lower()) == 1 and low.isalpha() and unicodedata.is_normalized("NFC", letter)


class Encoder:
    """ids of whole texts, as bytes of little-endian unsigned integers of ``width`` bytes."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        #: Two kinds are cut: those that throw blanks away, and byte-level ones whose words carry one blank in front.
        steps = pre.get("pretokenizers", [pre])
        drops = steps[0].get("type") == "Split" and steps[0].get("invert") and steps[0].get("behavior") == "Removed" and r"\s" in json.dumps(steps[0])[1:] and not any(x.get("add_prefix_space") for x in steps)
        keeps = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        plain = spec["model"]["type"] == "BPE" and not any(" " in s for s in self.special)
        plain = plain and bool(self.special) and (keeps or bool(spec["model"].get("end_of_word_suffix")))
        self.mode = "drops" if drops and plain else "keeps" if keeps and plain else "whole"
        self.blank = " " if self.mode == "keeps" else ""
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        suffix = spec["model"].get("end_of_word_suffix")
        self.edge = np.array([n.startswith("\u0120") if self.mode == "keeps" else bool(suffix) and n.endswith(suffix) for n in names])
        self.mark = np.array([bool(self.special) and n == self.special[0] for n in names])
        self.ends = {c for c in ENDS if not any(c in s for s in self.special)}
        self.has_special = re.compile("|".join(map(re.escape, self.special)) or "(?!)").search
        self.words: dict[str, bytes] = {}
        self.held = 0
        #: Words that begin or end with a blank.
        self.beside: set[str] = set()
        self.heads: dict[str, bytes] = {}
        self.cache_entries = cache_entries

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn(self, missing: list[str]) -> None:
        words = self.words
        if self.mode == "keeps":
            ask = []
            for w in missing:
                if not w or w[0].isspace() or w[-1].isspace():
                    words[w] = b""  # next to blanks: its text goes to the library as a whole
                    self.beside.add(w)
                else:
                    ask.append(w)
        else:
            ask = [w for w in missing if w]
            words[""] = b""
        # Such a sign is a piece of its own under both kinds, so stems are asked once.
        alone, signs = functools.cache(ends_alone), self.ends
        ends = {w: (w[:-1], w[-1]) for w in ask if w[-1] in signs and len(w) > 1 and alone(w[-2])}
        ask = list({ends[w][0] if w in ends else w for w in ask}.difference(words))
        special = [w for w in ask if self.has_special(w)]
        for w in special:
            words[w] = self.whole(self.blank + w)
        if special:
            ask = [w for w in ask if w not in words]
        if self.mode == "keeps":
            plain, odd = ask, []
        else:
            plain = [w for w in ask if w.isalpha() and (w.isascii() or max(w) < "\u0100")]
            odd = set(ask).difference(plain)
        self._ask(plain, " ", self.edge)
        self._ask(list(odd), self.special[0], self.mark)
        for w, (stem, end) in ends.items():
            words[w] = words[stem] + self._alone(end)

    def _ask(self, ask: list[str], between: str, edge: np.ndarray) -> None:
        """Learns the words, many in one string; ``edge`` tells the ids at which one of them begins or ends.

        Joined by a blank, a word begins with the one id that has its blank in front, or ends with the one that
        closes a word. Joined by a special token, which the library reads as one id, any word stands alone.
        """
        parts = [ask[i : i + JOINED] for i in range(0, len(ask), JOINED)]
        head = self.blank if between == " " else ""
        texts = [head + between.join(p if between == " " else [self.blank + w for w in p]) for p in parts]
        for part, enc in zip(parts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(enc.ids, self.dtype)
            at = np.flatnonzero(edge[ids])
            if between != " ":
                first, last = [0, *(at + 1).tolist()], [*at.tolist(), len(ids)]
            elif self.mode == "keeps":
                first, last = at.tolist(), [*at[1:].tolist(), len(ids)]
            else:
                first, last = [0, *(at[:-1] + 1).tolist()], (at + 1).tolist()
            raw, size = ids.tobytes(), self.width
            for w, a, b in zip(part, first, last, strict=True):
                self.words[w] = raw[a * size : b * size]

    def _alone(self, text: str) -> bytes:
        """ids of a string that has no blank in front."""
        found = self.heads.get(text)
        if found is None:
            found = self.whole(text)
            if len(text) <= KEPT_CHARS:
                if len(self.heads) > self.cache_entries // 8:
                    self.heads.clear()
                self.heads[text] = found
        return found

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """The ids of every text; none of them null."""
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        if self.mode == "whole":
            return [self.whole(t) for t in texts.to_pylist()]
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        end, out, at = np.cumsum(size), [], 0
        while at < len(size):
            upto = max(at + 1, int(np.searchsorted(end, end[at] - size[at] + AT_ONCE, side="right")))
            part = texts.slice(at, upto - at)
            out += self._together(part, size[at:upto]) if upto > at + 1 or size[at] <= AT_ONCE else [self._long(part[0].as_py())]
            at = upto
        return out

    def _known(self, words: list[str]) -> list[bytes]:
        """The words' ids, asking the library for those that are not in the table. ``words`` are distinct."""
        table = self.words
        found = list(map(table.get, words))
        missing = [w for w, x in zip(words, found, strict=True) if x is None]
        if not missing:
            return found
        if len(table) + len(missing) > self.cache_entries or self.held > ENTRY_BYTES * self.cache_entries:
            self.beside.intersection_update(table)  # of this call's words none is gone yet
            for w in list(itertools.islice(table, self.cache_entries // 2)):  # the older half goes; what recurs is soon back
                self.held -= 4 * len(w) + len(table.pop(w))
        before = len(table)
        self._learn(missing)
        get = table.__getitem__
        out = list(map(get, words)) if len(missing) == len(words) else [get(w) if x is None else x for w, x in zip(words, found, strict=True)]
        fresh = list(itertools.islice(reversed(table), len(table) - before))
        if max(map(len, fresh)) > KEPT_CHARS:
            for w in fresh:
                if len(w) > KEPT_CHARS and w not in self.beside:
                    del table[w]
            fresh = [w for w in fresh if w in table]
        self.held += 4 * sum(map(len, fresh)) + sum(map(len, map(get, fresh)))
        return out

    def _together(self, texts: pa.Array, chars: np.ndarray) -> list[bytes]:
        """Texts by their distinct words: one look into the table for each, the rest is array work."""
        split = pc.split_pattern(texts, " ")
        bounds, coded = split.offsets.to_numpy(), split.flatten().dictionary_encode()
        word = coded.indices.to_numpy()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # faster than to_pylist
        found = self._known(names)
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.width
        ids = np.frombuffer(b"".join(found), self.dtype)
        length = size[word]
        if self.mode == "keeps":
            length[bounds[:-1]] = 0  # first words have no blank in front
        end = np.cumsum(length)
        source = np.repeat((np.cumsum(size) - size)[word] - (end - length), length) + np.arange(end[-1] if len(end) else 0)
        raw = ids[source].tobytes()
        at = (np.concatenate([[0], end])[bounds] * self.width).tolist()
        out = [raw[x:y] for x, y in zip(at, at[1:], strict=False)]
        if self.mode == "keeps":
            beside = np.zeros(len(texts), bool)
            if self.beside.intersection(names):
                blank = np.array([w in self.beside for w in names], bool)[word]
                beside = np.add.reduceat(blank, bounds[:-1]) > 0
            out = [self.whole(texts[i].as_py()) if b else (self._alone(names[w]) if n else b"") + x for i, (n, x, b, w) in enumerate(zip(chars.tolist(), out, beside, word[bounds[:-1]].tolist(), strict=True))]
        return out

    def _long(self, text: str) -> bytes:
        """A text too long for arrays of its ids at once."""
        parts, at = [], 0
        while at <= len(text):
            end = text.find(" ", min(len(text), at + AT_ONCE))
            end = len(text) if end < 0 else end
            pieces = text[at:end].split(" ")
            names = list(set(pieces))
            known = dict(zip(names, self._known(names), strict=True))
            if self.beside.intersection(names):
                return self.whole(text)
            if self.mode == "keeps" and not at:
                known[""] = self._alone(pieces[0])
                pieces[0] = ""
            parts += map(known.__getitem__, pieces)
            at = end + 1
        return b"".join(parts)


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, cache_entries: int = CACHE_ENTRIES) -> Encoder:
    """The worker's encoder of a tokenizer file."""
    if (path, cache_entries) not in _encoders:
        _encoders[path, cache_entries] = Encoder(path, cache_entries)
    return _encoders[path, cache_entries]


def public_path(name: str) -> str:
    """A file of the public tokenizers' package, where the task runs."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
