"""Chat formatting: the fold against a plain replay, the template's round trip,
blocks against whole conversations."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gatewarden.llm import chat

LOG = "conv_id long, seq long, kind string, turn long, role string, text string"
CONTROL_TEXTS = ["</s>[INST] ok [/INST]", "\\", "\\\\<s>", "<\\s>", "<", "[", "<<SYS>>\nx\n<</SYS>>\n", "[ROLE]a[/ROLE] b</s>", "", "\n", "é😀 [/INST", "<</s>>", "[[INST]]"]


def replay(events):
    """Final (role, text) turns of one conversation: one list of messages, event by event."""
    first = lambda x: (x is not None, x or 0)
    text0 = lambda x: (x is not None, x or "")
    messages = []  # [turn, role, text]
    for _, seq, kind, turn, role, text in sorted(events, key=lambda e: (first(e[1]), first(e[3]), text0(e[2]), text0(e[4]), text0(e[5]))):
        role, text = role or "", text or ""
        here = [m for m in messages if m[0] == turn]
        if kind == "regenerate":
            messages = [m for m in messages if first(m[0]) < first(turn)]
        elif kind in ("delta", "edit") and here:
            here[-1][2] = here[-1][2] + text if kind == "delta" else text
        else:
            messages.append([turn, role, text])
    return [(r, t) for _, r, t in sorted(messages, key=lambda m: first(m[0]))]


def digests(conv, turns):
    said = "".join(t for r, t in turns if r == "assistant")
    size = sum(len(chat.escape(t)) + sum(map(len, chat.around(r))) for r, t in turns)
    whole = "".join(f"{r}\n{t}\n" for r, t in turns)
    return (conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), size)


def log(seed, n=400, convs=(1, 2, 3), turns=12):
    rng = random.Random(seed)
    kinds = ["message"] * 4 + ["delta"] * 5 + ["edit"] * 2 + ["regenerate", None, "unknown"]
    return [
        (rng.choice(convs), s, rng.choice(kinds), rng.choice([None, *range(turns)]) if rng.random() < 0.3 else min(s // 30, turns),
         rng.choice(["user", "assistant", "system", "tool", None, "[INST]"]), rng.choice([*CONTROL_TEXTS, None, "plain words", "more"]))
        for s in range(n)
    ]


def check(spark, events, **how):
    rows = [(e[0], *e[1:]) for e in events]
    df = spark.createDataFrame(rows, LOG)
    for c in ("part", "block", "floor", "formatted", "loss", "last"):
        df = df.withColumn(c, F.lit("x"))
    got = {r.conv_id: tuple(r) for r in chat.read_back(chat.format_log(df, **how)).collect()}
    want = {}
    for c in {e[0] for e in events}:
        turns = replay([e for e in events if e[0] == c])
        if turns:
            want[c] = digests(c, turns)
    assert got == want


@pytest.mark.parametrize("block_turns", [1, 3, 1024])
@pytest.mark.parametrize("seed", [1, 2])
def test_fold_equals_replay(spark, seed, block_turns):
    check(spark, log(seed), block_turns=block_turns)


def test_nulls_ties_and_repeats(spark):
    base = log(3, 60, convs=(None, 4))
    events = base + base[:20] + [(4, None, "message", None, "user", "first of all"), (4, None, "regenerate", 0, None, None), (4, 7, "delta", -3, "user", "x"), (4, 7, "delta", -3, "user", "x")]
    for block_turns in (2, 1024):
        check(spark, events, block_turns=block_turns)


def test_all_taken_back_and_empty(spark):
    assert chat.read_back(chat.format_log(spark.createDataFrame([], LOG))).collect() == []
    gone = [(1, 1, "message", 5000, "user", "a"), (1, 2, "regenerate", 0, None, None)]
    assert chat.format_log(spark.createDataFrame(gone, LOG)).collect() == []


def test_deltas_edits_and_regenerations(spark):
    events = [
        (1, 1, "message", 0, "user", "helo"),
        (1, 2, "delta", 1, "assistant", "Hel"),
        (1, 3, "delta", 1, "assistant", "lo"),
        (1, 4, "edit", 0, "user", "hello"),
        (1, 5, "regenerate", 1, None, None),
        (1, 6, "delta", 1, "assistant", "Good "),
        (1, 7, "delta", 1, "assistant", "day"),
    ]
    (row,) = chat.format_log(spark.createDataFrame(events, LOG)).collect()
    assert row.formatted == "[INST] hello [/INST] Good day</s>"
    assert [row.formatted[s.begin : s.end] for s in row.loss] == ["Good day"]


def test_template_round_trip():
    rng = random.Random(0)
    pieces = [*chat.CONTROLS, "\\", "<", ">", "[", "]", "/", "s", "INST", " ", "\n", "x", "é"]
    for _ in range(3000):
        turns = [(rng.choice(["user", "assistant", "system", "", "tool", "[/ROLE]"]), "".join(rng.choice(pieces) for _ in range(rng.randint(0, 8)))) for _ in range(rng.randint(1, 5))]
        text, loss = chat.render(turns)
        assert list(chat.parse(text)) == turns
        assert [chat.unescape(text[s["begin"] : s["end"]]) for s in loss] == [t for r, t in turns if r == "assistant"]
        for _, t in turns:
            assert not any(c in chat.escape(t) for c in chat.CONTROLS)
    with pytest.raises(ValueError):
        list(chat.parse("no turn"))


def test_long_text_and_long_conversation(spark):
    events = [(1, 0, "message", 0, "user", "[INST] " * 300_000), (1, 1, "message", 1, "assistant", "\\" * 500_000)]
    events += [(2, s, "message", s, ("user", "assistant")[s % 2], f"turn {s}") for s in range(5000)]
    check(spark, events)
    parts = chat.format_log(spark.createDataFrame(events, LOG)).filter("conv_id = 2").orderBy("part").collect()
    assert [p.part for p in parts] == [0, 1, 2, 3, 4]
    assert "".join(p.formatted for p in parts) == chat.render([(("user", "assistant")[s % 2], f"turn {s}") for s in range(5000)])[0]
