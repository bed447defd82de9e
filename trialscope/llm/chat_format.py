"""Chat formatting from event logs: fold deltas, edits and regenerations, then render and read back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The template's control strings.
TURN_START, ROLE_END, TURN_END = "### ", ": ", "</turn>\n"

_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): (.*?)</turn>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_HASHES = re.compile(r"#(?=##)")



def escape(text: str) -> str:
    """No control string is left in the result; unescape() gives the text back."""
    return _HASHES.sub(r"#\\", text.replace("\\", "\\\\")).replace("</turn>", "<\\/turn>")


def escape_role(role: str) -> str:
    return escape(role).replace(":", "\\:")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def conversation_events(conversations: DataFrame) -> DataFrame:
    """Each row as a start event with its role and a delta event with its text.

    Null text counts as empty, null role as an empty one. Rows of one conversation with the same
    turn are separate messages, ordered by role and then text. A null turn comes first.
    """
    by_turn = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.row_number().over(by_turn))
    event = lambda n, kind, role, text: F.struct(F.lit(n).cast("long").alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))
    none = F.lit(None).cast("string")
    events = F.array(event(0, "start", F.col("role"), none), event(1, "delta", none, F.col("text")))
    return rows.select("conv_id", "turn", "tie", F.explode(events).alias("e")).select("conv_id", "turn", "tie", "e.*")


def fold(events: Iterator[tuple]) -> Iterator[tuple]:
    """(conversation, message) keys with role and text, from (key, kind, role, text) in order.

    start opens the message, delta appends to it, edit replaces what it says, regenerate discards
    what was streamed so far. One message is held at a time, whatever the conversation's length.
    """
    key, role, parts, opened = None, "", [], False
    for now, kind, new_role, text in events:
        if now != key or not opened:
            if opened:
                yield key, role, "".join(parts)
            key, role, parts, opened = now, "", [], True
        if kind == "start":
            role = new_role or ""
            parts = [text] if text else []
        elif kind == "delta":
            parts.append(text or "")
        elif kind == "edit":
            parts = [text or ""]
        elif kind == "regenerate":
            parts = []
    if opened:
        yield key, role, "".join(parts)


def format_chat(events: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Rendered messages: conv_id, position, formatted, loss_start, loss_end, end.

    The log is partitioned by conversation and sorted by (turn, tie, seq); a task streams through
    its rows holding one message. formatted is one turn of the template; joined in the order of
    position, a conversation's turns are its formatted text. loss_start and loss_end are code point
    offsets in that whole text of what loss_role says (null for other roles); end is where the turn
    ends.

    Defined cases: an event of an unknown kind changes nothing; a message without a start event has
    an empty role; null conv_id is a conversation of its own; an empty log gives an empty result.
    A repeated event is applied twice, as the log says. A very long text is one message, held whole.
    Other columns of events are ignored, whatever their names.
    """
    ordered = events.select("conv_id", "turn", "tie", "seq", "kind", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "tie", "seq")

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            for b in batches:
                keys = b[["conv_id", "turn", "tie"]].astype(object).where(b[["conv_id", "turn", "tie"]].notna(), None)
                for key, kind, role, text in zip(keys.itertuples(index=False, name=None), b["kind"], b["role"], b["text"], strict=True):
                    yield key, kind, role, text

        out, conv, at, n, size = [], object(), 0, 0, 0
        for key, role, text in fold(rows()):
            if key[0] != conv:
                conv, at, n = key[0], 0, 0
            head, body = f"{TURN_START}{escape_role(role)}{ROLE_END}", escape(text)
            turn = f"{head}{body}{TURN_END}"
            mine = role == loss_role
            out.append((conv, n, turn, at + len(head) if mine else None, at + len(head) + len(body) if mine else None, at + len(turn)))
            at, n, size = at + len(turn), n + 1, size + len(turn)
            if len(out) >= 5000 or size > 8 << 20:
                yield framed(out)
                out, size = [], 0
        if out:
            yield framed(out)

    def framed(rows: list[tuple]) -> pd.DataFrame:
        df = pd.DataFrame(rows, columns=["conv_id", "position", "formatted", "loss_start", "loss_end", "end"])
        return df.astype({"conv_id": "Int64", "loss_start": "Int64", "loss_end": "Int64"})

    return ordered.mapInPandas(render, "conv_id long, position long, formatted string, loss_start long, loss_end long, end long")


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, parsed from its formatted text: n_turns and the digests of turns and loss.

    Rows are dealt by conversation and sorted by position; running digests hold no more than a turn.
    """
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "position")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, out = None, []

        def close() -> tuple:
            conv, turns, loss, n, chars, whole = state
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), whole

        for b in batches:
            for conv, text, start, end, at in zip(b["conv_id"].astype(object).where(b["conv_id"].notna(), None), b["formatted"], b["loss_start"], b["loss_end"], b["end"], strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        out.append(close())
                    state = [conv, hashlib.sha256(), hashlib.sha256(), 0, 0, 0]
                for role, said in _TURN.findall(text):
                    state[1].update(f"{unescape(role)}\n{unescape(said)}\n".encode("utf-8", "surrogatepass"))
                    state[3] += 1
                if not pd.isna(start):
                    before = int(at) - len(text)
                    under = unescape(text[int(start) - before : int(end) - before])
                    state[2].update(under.encode("utf-8", "surrogatepass"))
                    state[4] += len(under)
                state[5] += len(text)
            if len(out) >= 2000:
                yield pd.DataFrame(out, columns=COLUMNS).astype({"conv_id": "Int64"})
                out = []
        if state is not None:
            out.append(close())
        if out:
            yield pd.DataFrame(out, columns=COLUMNS).astype({"conv_id": "Int64"})

    return ordered.mapInPandas(parse, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


COLUMNS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
