"""Chat formatting by a grammar round trip.

A conversation is rendered as ``<s>role\\n text </s>\\n`` turn by turn (no blanks).
Each rendered turn is parsed again by the grammar; if what comes back is not the
source, the conflicting control strings of the text are escaped and it is rendered
anew until it does. The parser undoes escapes, so any text survives, also one that
has control strings or escapes of its own.

A row is formatted on its own and rows stream by conversation and turn, so a
conversation of any length needs the memory of a batch.

Defined results: null role, null text and empty text are empty; rows of one
conversation are ordered by turn (null first), then role, then text, so ties and
repeated rows keep a fixed order; rows with a null conv_id are one conversation; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

OPEN, CLOSE = "<s>", "</s>"
#: A control string in which backslashes follow the first sign is an escaped one.
_CONTROL, _ESCAPED = re.compile(r"<(\\*)(/?s>)"), re.compile(r"<\\(\\*)(/?s>)")
_TURN = re.compile(r"<s>([^\n<]*+)\n([^<]*+(?:<(?!/?s>)[^<]*+)*+)</s>\n")
#: Signs that would end a role early, as written in the header.
_ROLE = {"\\": "\\\\", "\n": "\\n", "<": "\\l"}
_ROLE_BACK = {v: k for k, v in _ROLE.items()}
TRAINED = "assistant"


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1\2", text)


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """Role, text, and the place of the text as rendered, of each turn. Raises ValueError where the grammar doesn't hold."""
    out, at = [], 0
    while at < len(rendered):
        if not (m := _TURN.match(rendered, at)):
            raise ValueError(f"no turn at {at}")
        role = re.sub(r"\\.", lambda x: _ROLE_BACK[x[0]], m[1], flags=re.S)
        out.append((role, unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return out


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn as rendered, and the place of its text there."""
    head = f"{OPEN}{''.join(_ROLE.get(c, c) for c in role)}\n"
    body = text
    for _ in range(3):
        whole = f"{head}{body}{CLOSE}\n"
        try:
            back = parse(whole)
        except (ValueError, KeyError):
            back = []
        if [x[:2] for x in back] == [(role, text)]:
            return whole, back[0][2], back[0][3]
        body = escape(body)
    raise ValueError("a turn doesn't survive the round trip")


def format_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, rendered, loss_start, loss_end`` of each row, in the order of each conversation within a partition.

    The rendered turns of a conversation, one after the other, are its formatted
    text. The span (code points of ``rendered``) is what the loss covers: the text
    of an assistant's turn, else nothing.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [(whole, a, b if role == TRAINED else a) for role, text in zip(batch["role"].to_pylist(), batch["text"].to_pylist(), strict=True) for whole, a, b in [render(role or "", text or "")]]
            whole, a, b = zip(*done, strict=True) if done else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch["conv_id"], batch["turn"], pa.array(whole, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["conv_id", "turn", "rendered", "loss_start", "loss_end"])

    kinds = {c: conversations.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    ordered = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(work, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, rendered string, loss_start long, loss_end long")
