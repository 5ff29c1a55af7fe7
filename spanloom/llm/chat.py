"""Chat formatting with a grammar that reads its own output back.

Template. A turn is written as ``<s>[ROLE] text [/ROLE]``, where ROLE is INST for user turns and ANS for assistant
turns, SYS for system turns, and ``ROLE=name`` for any other; an assistant turn ends with ``</s>`` too, as that is
where a model stops. The control strings are those of the template. Inside a text a backslash in front of a control
string or of another backslash is read away.

Round trip. A turn is first written as it is and parsed by the deterministic parser. If the turn that comes back
isn't the same, or isn't alone, the control strings in its text are escaped, then its backslashes too, until it is.

The loss mask is part of the output: each written turn says where its text stands (``start``, ``end``, in code points)
and whether the mask lies over it (``loss``). What is trained on is read back from that, not from the roles.

A turn is a row of its own throughout: turns are written and parsed side by side, and a conversation's digests are
worked out over its turns in order as they stream by, so no conversation is held in memory. Texts move once, as written;
one that was escaped goes along as it was, for the order of turns that repeat a number.

Defined cases: a null text is empty; a null role is written as an unnamed role and comes back as an empty one; a null
turn comes first; turns that repeat a number are ordered by role and text; a null conv_id is a conversation; an empty
table has no conversations; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import table

#: The names of roles in the template.
NAMES = {"user": "INST", "assistant": "ANS", "system": "SYS"}
ROLES = {v: k for k, v in NAMES.items()}
#: The strings that control the template.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "[ANS]", "[/ANS]", "[SYS]", "[/SYS]", "[ROLE", "[/ROLE]"]
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_BACKSLASH = re.compile(r"\\")
_BOTH = re.compile(r"\\|" + _CONTROL.pattern)
# Every alternative begins with a character of its own, so that a search skips what begins none.
_TOKEN = re.compile(r"\\(\\|" + _CONTROL.pattern + ")|" + _CONTROL.pattern)
_OPEN = re.compile(r"<s>\[(INST|ANS|SYS|ROLE=((?:[^\]\\]|\\.)*))\] ", re.S)


class Turn:
    """A parsed turn; ``span`` is the place of its text in the rendered string."""

    __slots__ = ("role", "span", "text")

    def __init__(self, role: str, text: str, span: tuple[int, int]):
        self.role, self.text, self.span = role, text, span


def _opening(role: str) -> tuple[str, str]:
    name = NAMES.get(role)
    if name is None:
        return "<s>[ROLE=" + re.sub(r"[\\\]]", lambda m: "\\" + m[0], role) + "] ", " [/ROLE]"
    return f"<s>[{name}] ", f" [/{name}]" + ("</s>" if name == "ANS" else "")


def parse(rendered: str) -> list[Turn]:
    """The turns of a rendered string; ValueError where it doesn't follow the grammar."""
    out, at = [], 0
    while at < len(rendered):
        m = _OPEN.match(rendered, at)
        if not m:
            raise ValueError(f"no turn begins at {at}")
        role = ROLES[m[1]] if m[2] is None else re.sub(r"\\(.)", r"\1", m[2], flags=re.S)
        close = _opening(role)[1] if m[2] is None else " [/ROLE]"
        start, at = m.end(), m.end()
        pieces, last = [], start
        while True:
            t = _TOKEN.search(rendered, at)
            if not t:
                raise ValueError("a turn doesn't end")
            if t[1] is not None:  # escaped: the backslash is read away
                pieces.append(rendered[last : t.start()])
                pieces.append(t[1])
                at = last = t.end()
                continue
            end = t.start() - 1
            if end < last or not rendered.startswith(close, end):
                raise ValueError(f"a control string stands at {t.start()}")
            pieces.append(rendered[last:end])
            out.append(Turn(role, "".join(pieces), (start, end)))
            at = end + len(close)
            break
    return out


def _same(rendered: str, role: str, text: str) -> bool:
    try:
        found = parse(rendered)
    except ValueError:
        return False
    return len(found) == 1 and found[0].role == role and found[0].text == text


def render(role: str | None, text: str | None) -> str:
    """A turn as the template has it, escaped as far as the way back needs."""
    role, text = role or "", text or ""
    head, tail = _opening(role)
    for pattern in (None, _CONTROL, _BOTH):
        rendered = head + (pattern.sub(lambda m: "\\" + m[0], text) if pattern else text) + tail
        if _same(rendered, role, text):
            return rendered
    raise ValueError("a turn can't be written so that it reads back the same")


def unescaped(masked: str) -> str:
    """What a stretch of a rendered turn's text says; ValueError where a control string stands in it."""

    def read(m: re.Match) -> str:
        if m[1] is None:
            raise ValueError(f"a control string stands at {m.start()}")
        return m[1]

    return _TOKEN.sub(read, masked)


def rendered_turns(turns: DataFrame, learned: Sequence[str] = ("assistant",)) -> DataFrame:
    """Adds ``formatted`` and its mask (``start``, ``end``, ``loss``) to (conv_id, turn, role, text); one row a turn.

    ``learned`` are the roles under the mask.
    """
    learned = set(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roles = b.column(2).to_pylist()
            out = [render(r, t) for r, t in zip(roles, b.column(3).to_pylist(), strict=True)]
            ends = [_opening(r) for r in roles]
            start = pa.array([len(head) for head, _ in ends], pa.int32())
            end = pa.array([len(o) - len(tail) for o, (_, tail) in zip(out, ends, strict=True)], pa.int32())
            loss = pa.array([r in learned for r in roles], pa.bool_())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string()), start, end, loss], names=["conv_id", "turn", "role", "text", "formatted", "start", "end", "loss"])

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "conv_id long, turn long, role string, text string, formatted string, start int, end int, loss boolean")


def conversations(formatted: DataFrame) -> DataFrame:
    """What the rendered conversations say, read back from ``formatted`` and its mask, one row a conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        rows: list[tuple] = []
        state = None

        def done() -> None:
            if state:
                rows.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        def batch() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows.clear()
            return b

        for b in batches:
            for conv, text, start, end, loss in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if state is None or state[0] != conv:
                    done()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for turn in parse(text):
                    state[1] += 1
                    state[2].update(f"{turn.role}\n{turn.text}\n".encode())
                if loss:
                    masked = unescaped(text[start:end])
                    state[3] += len(masked)
                    state[4].update(masked.encode())
                state[5] += len(text)
                if len(rows) >= 8192:
                    yield batch()
        done()
        if rows:
            yield batch()

    escaped = F.when(F.length("text") != F.col("end") - F.col("start"), F.col("text")).alias("escaped")
    keyed = formatted.select("conv_id", "turn", "role", escaped, "formatted", "start", "end", "loss").repartition("conv_id")
    text = F.coalesce("escaped", F.substring("formatted", F.col("start") + 1, F.col("end") - F.col("start")))
    order = (F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "said"))
    ordered = keyed.withColumn("said", text).sortWithinPartitions(*order).select("conv_id", "formatted", "start", "end", "loss")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: A conversation whose texts are the template's own strings.
PROBE = "</s>[INST] ok [/INST]"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return conversations(rendered_turns(turns))


_SQL_CONTROL = r"(<s>|</s>|\[INST\]|\[/INST\]|\[ANS\]|\[/ANS\]|\[SYS\]|\[/SYS\]|\[ROLE|\[/ROLE\])"
#: Escapes: none where a text holds neither control strings nor what reads as an escape.
OP5_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'
), m AS (
  SELECT *, regexp_matches(text, '{_SQL_CONTROL}') AS control, regexp_matches(text, '\\(\\|{_SQL_CONTROL[1:]}') AS escaped,
         regexp_matches(text, '\\{_SQL_CONTROL}|\\\\') AS slashed,
         len(regexp_extract_all(text, '{_SQL_CONTROL}')) AS n_control, len(text) - len(replace(text, '\', '')) AS n_slash,
         CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 20 WHEN 'system' THEN 16
              ELSE 19 + len(role) + len(regexp_extract_all(role, '[\\\]]')) END AS frame
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN len(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
       CAST(sum(frame + len(text) + CASE WHEN NOT control AND NOT escaped THEN 0 WHEN NOT slashed THEN n_control ELSE n_control + n_slash END) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op5_chat_format": op5_chat_format}
SQL = {"op5_chat_format": OP5_SQL}
