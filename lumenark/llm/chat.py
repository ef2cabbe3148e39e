"""Chat formatting that is proved by reading it back.

Grammar:  conversation = turn*      turn = "<|im_start|>" role "\\n" body "<|im_end|>" "\\n"

A rendered turn is parsed by this grammar and compared with its source; while they differ, its content is escaped once
more. Escaping puts a backslash after each "<" that starts "<|", "<\\|", "<\\\\|" and so on; the parser takes one away.
The loss mask covers exactly the bodies of assistant turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenark.llm.common import map_chunks

START, END = "<|im_start|>", "<|im_end|>"
_OPEN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "<\\" in text else text


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role)) if "\\" in role else role


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """(role, text, body start, body end) of each turn. Anything outside the grammar raises ValueError."""
    out, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(START, at):
            raise ValueError("a turn must begin with its control string")
        line = rendered.find("\n", at)
        end = rendered.find(END, line + 1)
        if line < 0 or end < 0 or rendered[end + len(END) : end + len(END) + 1] != "\n":
            raise ValueError("a turn is not closed")
        head, body = rendered[at + len(START) : line], rendered[line + 1 : end]
        if START in body or START in head or END in head:
            raise ValueError("a control string inside a turn")
        out.append((_unescape_role(head), unescape(body), line + 1, end))
        at = end + len(END) + 1
    return out


def render(role: str, text: str) -> str:
    """One turn, escaped only as far as reading it back needs."""
    head, body, tried = role, text, False
    while True:
        rendered = f"{START}{head}\n{body}{END}\n"
        try:
            turns = parse(rendered)
            same = [t[:2] for t in turns] == [(role, text)]
        except ValueError:
            same = False
        if same:
            return rendered
        if not tried and _escape_role(role) != role:
            head, tried = _escape_role(role), True
        else:
            body = escape(body)


def _render_batch(loss_role: str):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rendered, start, end = [], [], []
        for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
            role, text = role or "", text or ""
            r = render(role, text)
            a = r.index("\n") + 1
            rendered.append(r)
            start.append(a if role == loss_role else None)
            end.append(len(r) - len(END) - 1 if role == loss_role else None)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "turn", "role", "text")), pa.array(rendered, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["conv_id", "turn", "role", "text", "rendered", "loss_start", "loss_end"])

    return run


def format_turns(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Adds rendered, loss_start, loss_end to each turn; a conversation's format is its turns' one after another.

    The offsets count code points inside the turn's rendering and are null where no loss is taken. Null texts and roles
    count as empty. Turns are rendered one by one, so no conversation is gathered in one place. Other columns are dropped.
    """
    chosen = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return map_chunks(chosen, _render_batch(loss_role), "conv_id long, turn long, role string, text string, rendered string, loss_start long, loss_end long")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads sorted turns back as a stream; holds two hashes and three counts at a time."""
    done: list[tuple] = []
    now, state = None, None

    def close():
        if state is not None:
            done.append((now[0], state["n"], state["turns"].hexdigest(), state["loss"], state["text"].hexdigest(), state["chars"]))

    def out():
        cols = list(zip(*done, strict=True)) or [[]] * 6
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        done.clear()
        return batch

    for batch in batches:
        for conv, rendered, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "rendered", "loss_start", "loss_end")), strict=True):
            if now is None or now[0] != conv:
                close()
                now, state = (conv,), {"n": 0, "turns": hashlib.sha256(), "loss": 0, "text": hashlib.sha256(), "chars": 0}
            for role, text, _, _ in parse(rendered):
                state["n"] += 1
                state["turns"].update(f"{role}\n{text}\n".encode())
            if start is not None:
                masked = unescape(rendered[start:end])
                state["loss"] += len(masked)
                state["text"].update(masked.encode())
            state["chars"] += len(rendered)
        if len(done) >= 1000:
            yield out()
    close()
    yield out()


def read_back(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each conversation, from its rendering.

    Turns go by turn, ties by role and text; a null conv_id is a conversation of its own. A hash needs its conversation in
    order on one task, which streams it from sorted, spillable rows and holds no text but the current batch.
    """
    ordered = turns.select("conv_id", "turn", "role", "rendered", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "rendered")
    return ordered.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
