"""Chat formatting by event-sourced reconstruction (operator 12).

A conversation is a log of events (conv_id, seq, kind, turn, role, text):

* ``message``     a message begins at ``turn`` (after any that stand there)
* ``delta``       text streamed onto the last message of the turn (one begins if none stands)
* ``edit``        the text of the turn's last message is replaced (one begins if none stands)
* ``regenerate``  the messages of this turn and of all later turns are taken back

The log is dealt out by conversation, sorted by sequence and folded into the
final messages, which are rendered in order of their turns.  What happens in a
block of ``BLOCK_TURNS`` turns depends on other blocks only by the last
regeneration of an earlier one, which a small table of (conversation, block)
carries over; so a long conversation is dealt out by block, a task holds the
messages of one block at a time, and no conversation must fit a task.

Each block gives a part of the formatted text and the spans that count for the
loss (assistant texts, in code points of the part); a conversation is its parts
in order.  Control strings inside texts and roles are broken by a backslash after
their first character and backslashes are doubled, which ``unescape`` reverses.

``read_back`` parses parts into turns again.

Defined results: null or unknown kind: ``message``.  Null text or role: empty.
Null turn or seq: before all others (a null turn is a block of its own).  Events
of one sequence number apply in order of turn, kind, role, text.  A null conv_id
is a conversation.  A conversation whose messages are all taken back has no row.
Repeated rows are events like others.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import limit_arrow_batches

BLOCK_TURNS = 1024
#: Rendered rows go on in batches of about so many characters.
BATCH_CHARS = 4 << 20

#: ``<s>`` opens a sequence; tokenizers put it there, so it is only escaped here.
BEGIN, END = "<s>", "</s>"
USER, USER_END = "[INST]", "[/INST]"
SYSTEM, SYSTEM_END = "<<SYS>>", "<</SYS>>"
ROLE, ROLE_END = "[ROLE]", "[/ROLE]"
#: No control string ends as another begins, so none can arise across a joint.
CONTROLS = (BEGIN, END, USER, USER_END, SYSTEM, SYSTEM_END, ROLE, ROLE_END)

_TO_ESCAPE = re.compile("|".join([r"\\", *map(re.escape, CONTROLS)]))
_ESCAPED = re.compile(r"\\(.)", re.S)

#: What stands around a text of each role; other roles carry their name.
MARKUP = {
    "system": (f"{SYSTEM}\n", f"\n{SYSTEM_END}\n"),
    "user": (f"{USER} ", f" {USER_END}"),
    "assistant": (" ", END),
}

PART_SCHEMA = "conv_id long, part long, formatted string, loss array<struct<begin: long, end: long>>"
TURN_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def around(role: str) -> tuple[str, str]:
    return MARKUP.get(role) or (f"{ROLE}{escape(role)}{ROLE_END} ", END)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[dict[str, int]]]:
    """(role, text) turns -> text and loss spans."""
    out, at, loss = [], 0, []
    for role, text in turns:
        before, after = around(role)
        body = escape(text)
        at += len(before)
        if role == "assistant":
            loss.append({"begin": at, "end": at + len(body)})
        out += before, body, after
        at += len(body) + len(after)
    return "".join(out), loss


_TURN = re.compile(
    f"{re.escape(SYSTEM)}\n(?P<system>.*?)\n{re.escape(SYSTEM_END)}\n"
    f"|{re.escape(USER)} (?P<user>.*?) {re.escape(USER_END)}"
    f"|{re.escape(ROLE)}(?P<role>.*?){re.escape(ROLE_END)} (?P<other>.*?){re.escape(END)}"
    f"| (?P<assistant>.*?){re.escape(END)}",
    re.S,
)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """The turns of one part; ValueError where the text isn't one that ``render`` gives."""
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        kind = m.lastgroup
        yield (unescape(m["role"]), unescape(m["other"])) if kind == "other" else (kind, unescape(m[kind]))
        at = m.end()


def _order(x: int | None) -> tuple[bool, int]:
    return (x is not None, x or 0)


class Block:
    """The messages of one block of one conversation, event by event."""

    def __init__(self) -> None:
        self.turns: dict[int | None, list[tuple[str, list[str]]]] = {}

    def _last(self, turn: int | None, role: str) -> list[str]:
        stand = self.turns.setdefault(turn, [])
        if not stand:
            stand.append((role, []))
        return stand[-1][1]

    def apply(self, kind: str | None, turn: int | None, role: str | None, text: str | None) -> None:
        role, text = role or "", text or ""
        if kind == "delta":
            self._last(turn, role).append(text)
        elif kind == "edit":
            self._last(turn, role)[:] = [text]
        elif kind == "regenerate":
            for t in [t for t in self.turns if _order(t) >= _order(turn)]:
                del self.turns[t]
        else:
            self.turns.setdefault(turn, []).append((role, [text]))

    def messages(self) -> list[tuple[str, str]]:
        return [(role, "".join(pieces)) for t in sorted(self.turns, key=_order) for role, pieces in self.turns[t]]


_SORTED = ("conv_id", "block", "floor", "seq", "kind", "turn", "role", "text")
_PARTS = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("part", pa.int64()),
        ("formatted", pa.string()),
        ("loss", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
    ]
)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted events -> a part for each block in which a message stands."""
    rows: list[dict] = []
    held = 0
    key, block, floor = None, Block(), None

    def close() -> int:
        turns = block.messages()
        if not turns:
            return 0
        text, loss = render(turns)
        rows.append({"conv_id": key[0], "part": key[1], "formatted": text, "loss": loss})
        return len(text)

    for batch in batches:
        for conv, part, carried, seq, kind, turn, role, text in zip(*(batch[c].to_pylist() for c in _SORTED)):
            if (conv, part) != key:
                held += close()
                if held > BATCH_CHARS:
                    yield pa.RecordBatch.from_pylist(rows, _PARTS)
                    rows.clear()
                    held = 0
                # The row that carries a floor comes first in its block.
                key, block, floor = (conv, part), Block(), carried
            if carried is None and (floor is None or (seq is not None and seq >= floor)):
                block.apply(kind, turn, role, text)
    close()
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _PARTS)


def as_events(rows: DataFrame) -> DataFrame:
    """Finished messages (conv_id, turn, role, text) as a log: one event each."""
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("seq"),
        F.lit("message").alias("kind"),
        F.col("turn").cast("long").alias("turn"),
        "role",
        "text",
    )


def format_log(events: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """conv_id, part, formatted, loss: the parts of a conversation in order (null first)
    are its formatted text."""
    limit_arrow_batches(events.sparkSession)
    log = events.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.floor(F.col("turn") / F.lit(block_turns)).cast("long").alias("block"),
        F.lit(None).cast("long").alias("floor"),
        F.col("seq").cast("long").alias("seq"),
        "kind",
        F.col("turn").cast("long").alias("turn"),
        "role",
        "text",
    )
    # The last regeneration in any earlier block of the conversation.
    blocks = log.groupBy("conv_id", "block").agg(F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("last"))
    earlier = Window.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    floors = blocks.withColumn("floor", F.max("last").over(earlier)).filter(F.col("floor").isNotNull())
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("seq", "long"), ("kind", "string"), ("turn", "long"), ("role", "string"), ("text", "string"))]
    log = log.unionByName(floors.select("conv_id", "block", "floor", *nothing))
    dealt = log.repartition("conv_id", "block").sortWithinPartitions(
        "conv_id", "block", F.col("floor").asc_nulls_last(), "seq", "turn", "kind", "role", "text"
    )
    return dealt.select(*_SORTED).mapInArrow(_fold, PART_SCHEMA)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    schema = pa.schema(list(zip(names, kinds)))
    rows: list[dict] = []
    begun = False
    conv, n, turns, chars, loss, size = None, 0, None, 0, None, 0

    def close() -> None:
        rows.append(dict(zip(names, (conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))))

    for batch in batches:
        for c, text, spans in zip(*(batch[x].to_pylist() for x in ("conv_id", "formatted", "loss"))):
            if not begun or c != conv:
                if begun:
                    close()
                begun = True
                conv, n, turns, chars, loss, size = c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0
            size += len(text)
            for role, said in parse(text):
                n += 1
                turns.update(f"{role}\n{said}\n".encode())
            for span in spans:
                said = unescape(text[span["begin"] : span["end"]])
                chars += len(said)
                loss.update(said.encode())
        if len(rows) >= 1000:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows.clear()
    if begun:
        close()
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def read_back(parts: DataFrame) -> DataFrame:
    """Parsed from the formatted text and its loss spans: conv_id, n_turns, turns_sha256
    (role, line feed, text, line feed of each turn), loss_chars and loss_sha256 (texts
    under the loss), formatted_chars.  A digest over a conversation is a chain, so its
    parts stream through one task, one part in memory at a time."""
    limit_arrow_batches(parts.sparkSession)
    dealt = parts.select("conv_id", "part", "formatted", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return dealt.mapInArrow(_digests, TURN_SCHEMA)
