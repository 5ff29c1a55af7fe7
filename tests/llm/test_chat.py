import hashlib
import random

import pytest

from spanloom.llm import chat

BITS = ["\\", "<s>", "</s>", "[INST]", "[/INST]", "[", "]", " ", "\n", "a", "[/ROLE]", "[ROLE", "=", "ok", " [/ANS]</s>", "<", "s>", "/", "[SYS]", "\\\\", "é"]


def test_round_trip():
    rng = random.Random(7)
    for _ in range(8000):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "a]b\\", "", "x\n"]), "".join(rng.choices(BITS, k=rng.randint(0, 9)))) for _ in range(rng.randint(1, 3))]
        rendered = "".join(chat.render(*t) for t in turns)
        found = chat.parse(rendered)
        assert [(t.role, t.text) for t in found] == turns
        for t in found:
            a, b = t.span
            assert chat.render(t.role, t.text).find(rendered[a:b]) >= 0
    assert chat.render("user", "plain \\n text") == "<s>[INST] plain \\n text [/INST]"  # escaped only where needed


def test_not_the_grammar():
    for bad in ("x", "<s>[INST] a", "<s>[INST] a [/ANS]</s>", "<s>[INST] a <s> b [/INST]", "<s>[INST] a[/INST]"):
        with pytest.raises(ValueError):
            chat.parse(bad)


def test_mask_covers_what_the_parser_reads(spark):
    rng = random.Random(11)
    rows = [(i, 0, rng.choice(["user", "assistant", "system", "a]b\\", "assistant"]), "".join(rng.choices(BITS, k=rng.randint(0, 9)))) for i in range(400)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat.rendered_turns(turns).collect():
        (turn,) = chat.parse(r.formatted)
        assert turn.span == (r.start, r.end) and r.loss == (r.role == "assistant")
        assert chat.unescaped(r.formatted[r.start : r.end]) == r.text
    with pytest.raises(ValueError):
        chat.unescaped("a </s>")


def test_what_is_learned_follows_the_mask(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q [INST]"), (1, 1, "assistant", "a")], "conv_id long, turn long, role string, text string")
    written = chat.rendered_turns(turns, learned=["user"])
    got = chat.conversations(written).first()
    assert got.loss_chars == 8 and got.loss_sha256 == hashlib.sha256(b"q [INST]").hexdigest()
    none = chat.conversations(written.selectExpr("* except (loss)", "false as loss")).first()
    assert none.loss_chars == 0 and none.turns_sha256 == got.turns_sha256


def test_turns_that_repeat_a_number(spark):
    texts = ["b", "<s> b", "a", "a <s>", "\\<s>", "<", "é", ""]
    turns = spark.createDataFrame([(1, 0, "assistant", t) for t in texts], "conv_id long, turn long, role string, text string")
    got = chat.conversations(chat.rendered_turns(turns.repartition(4))).first()
    assert got.loss_sha256 == hashlib.sha256("".join(sorted(texts)).encode()).hexdigest()


def test_digests(spark):
    rows = [(1, 0, "system", "s"), (1, 2, "assistant", chat.PROBE), (1, 1, "user", "q"), (1, None, None, None), (2, 0, "assistant", "é"), (2, 0, "assistant", "é"), (None, 0, "user", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as formatted", "2 as n_turns")
    got = {r.conv_id: r for r in chat.conversations(chat.rendered_turns(turns)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got[1].n_turns == 4 and got[1].turns_sha256 == sha(f"\n\nsystem\ns\nuser\nq\nassistant\n{chat.PROBE}\n") and got[1].loss_sha256 == sha(chat.PROBE) and got[1].loss_chars == len(chat.PROBE)
    assert (got[2].n_turns, got[2].loss_chars, got[2].loss_sha256) == (2, 2, sha("éé")) and got[None].loss_sha256 == sha("")
    assert chat.conversations(chat.rendered_turns(turns.where("false"))).count() == 0
