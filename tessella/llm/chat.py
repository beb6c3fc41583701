"""Operator 7: format conversations by a compiled template, with a mask of what is learnt.

A template renders one turn, given what comes before and after it (first, last), so that a
conversation of any length is formatted as a stream: rows sorted by conversation and turn pass
through a task, and a long conversation becomes several parts of bounded size.

Control strings inside texts are escaped so that they can't be mistaken for the template's own:
`\\` becomes `\\\\`, and a control string gets a `\\` after its first character.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.templates import compile_template
from tessella.session import materialise

#: Strings that mark turns.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
#: One turn. Users, assistants and systems have marks of their own; other roles are named.
TURN = """
{%- if turn.role == 'user' -%}
[INST]{{ turn.text | escape }}[/INST]
{%- elif turn.role == 'assistant' -%}
<s>{% generation %}{{ turn.text | escape }}{% endgeneration %}</s>
{%- elif turn.role == 'system' -%}
<<SYS>>{{ turn.text | escape }}<</SYS>>
{%- else -%}
[ROLE]{{ turn.role | escape }}[/ROLE]{{ turn.text | escape }}</s>
{%- endif -%}
"""
#: Characters of formatted text in one part, about.
PART = 1 << 20

_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))))
_BREAK = re.compile(r"\\|" + _CONTROL.pattern)
_BACK = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """A text in which no control string occurs; unescape() gives the text back."""
    return _BREAK.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text) if "\\" in text else text


_NAMED = {"[INST]": ("user", "[/INST]"), "<s>": ("assistant", "</s>"), "<<SYS>>": ("system", "<</SYS>>")}


def turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted text, as they were."""
    at = 0
    marks = _CONTROL.finditer(formatted)
    for m in marks:
        if m.start() != at:
            raise ValueError(f"no turn begins at {at}")
        if m[0] in _NAMED:
            role, closing = _NAMED[m[0]]
        elif m[0] == "[ROLE]":
            named = next(marks)
            role, closing, m = unescape(formatted[m.end() : named.start()]), "</s>", named
        else:
            raise ValueError(f"{m[0]} at {at} opens no turn")
        end = next(marks)
        if end[0] != closing:
            raise ValueError(f"{end[0]} at {end.start()} closes no turn")
        yield role, unescape(formatted[m.end() : end.start()])
        at = end.end()
    if at != len(formatted):
        raise ValueError(f"no turn begins at {at}")


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_PARTS = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("more", pa.bool_()), ("formatted", pa.string()), ("loss", _SPANS)])
_PARTS_SQL = "conv_id long, part long, more boolean, formatted string, loss array<struct<start: long, end: long>>"


def _render(template: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts of the conversations of sorted rows. A turn is rendered once it is known whether it is the last."""
        render = compile_template(template, escape)
        rows: list[dict] = []
        text: list[str] = []
        loss: list[dict] = []
        length = part = 0
        waiting = None  # (conversation, role, text, first) of the turn before

        def flush(conv, more: bool) -> None:
            nonlocal length, part
            rows.append({"conv_id": conv, "part": part, "more": more, "formatted": "".join(text), "loss": list(loss)})
            text.clear()
            loss.clear()
            length, part = 0, part + 1 if more else 0

        def add(last: bool) -> None:
            nonlocal length
            conv, role, words, first = waiting
            out, marks = render({"turn": {"role": role, "text": words}, "first": first, "last": last})
            loss.extend({"start": length + a, "end": length + b} for a, b in marks)
            text.append(out)
            length += len(out)
            if last or length >= size:
                flush(conv, not last)

        for batch in batches:
            for conv, role, words in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                same = waiting is not None and waiting[0] == conv
                if waiting is not None:
                    add(not same)
                waiting = (conv, role.as_py() or "", words.as_py() or "", not same)
                if len(rows) >= 256 or rows and len(rows[-1]["formatted"]) >= size:
                    yield pa.RecordBatch.from_pylist(rows, _PARTS)
                    rows.clear()
        if waiting is not None:
            add(True)
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _PARTS)

    return run


def format_conversations(conversations: DataFrame, template: str = TURN, part_chars: int = PART) -> DataFrame:
    """conv_id, part, more, formatted, loss: a conversation's formatted text, in parts of about part_chars.

    loss: spans of `formatted` under the template's generation markers (code points, end
    exclusive); an empty one has no span. Rows of a conversation are its turns by `turn` (null
    first; ties by role, then text); repeated rows are turns of their own. A null role or text is
    empty, and rows with a null conv_id are one conversation. Parts are numbered from 0; `more`
    says that another follows. An empty table gives none. A text of any length is read whole; a
    conversation is one task's. Other columns, whatever their names, are not read.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(_render(template, part_chars), _PARTS_SQL)


_READ_SQL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation of parts in order."""
    out: list[tuple] = []

    def fresh() -> list:
        return [0, hashlib.sha256(), 0, hashlib.sha256(), 0]

    def emit() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
        out.clear()
        return batch

    state = fresh()
    for batch in batches:
        for row in batch.to_pylist():
            for role, text in turns(row["formatted"]):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            for span in row["loss"]:
                text = unescape(row["formatted"][span["start"] : span["end"]])
                state[2] += len(text)
                state[3].update(text.encode())
            state[4] += len(row["formatted"])
            if not row["more"]:
                out.append((row["conv_id"], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
                state = fresh()
        if out:
            yield emit()


def read_back(parts: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from formatted parts alone.

    Conversations of one part are read where they lie; the parts of longer ones are brought together in order.
    """
    parts = parts.select("conv_id", "part", "more", "formatted", "loss")
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = parts.where("part = 0 and not more").mapInArrow(_read, _READ_SQL)
    long = parts.where("part > 0 or more").repartition(n, "conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_read, _READ_SQL)
    return whole.unionByName(long)


def digest(conversations: DataFrame, template: str = TURN, part_chars: int = PART) -> DataFrame:
    """Format the conversations, write the parts as Parquet, and describe them as read back."""
    return read_back(materialise(format_conversations(conversations, template, part_chars), "formatted"))
