"""Chat formatting by incremental rendering of a template that is a black box.

Successive prefixes of the turns are rendered and consecutive outputs compared: what a turn adds is
its span. The text inside a span is found by rendering the turn without its text. A template whose
output for a longer prefix does not continue the shorter one's rewrites history: its turns have no
spans, and the loss mask is empty.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require, valid_text

START, END = "<|im_start|>", "<|im_end|>"
Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

OUTPUT = (
    "conv_id long, n_turns long, formatted string, spans array<struct<role:string,start:long,`end`:long,"
    "text_start:long,text_end:long>>, loss_spans array<struct<start:long,`end`:long>>, rewrites_history boolean"
)


def escape(text: str) -> str:
    """No '<|' is left: a backslash goes between, one more if there are any. Reversible."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text) if "\\" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def chatml(turns: list[Turn]) -> str:
    return "".join(f"{START}{escape_role(role)}\n{escape(text)}{END}\n" for role, text in turns)


def parse_chatml(formatted: str) -> list[Turn]:
    """The turns of a chatml output, unescaped."""
    parts = formatted.split(START)[1:]
    out = []
    for part in parts:
        role, _, rest = part.partition("\n")
        out.append((unescape_role(role), unescape(rest.removesuffix("\n").removesuffix(END))))
    return out


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


#: A text that no template treats specially.
MARK = "\u2063"


def locate(turns: list[Turn], template: Template) -> tuple[str, list[tuple] | None]:
    """The output and for each turn (role, start, end, text start, text end), by rendering one prefix of the
    turns after the other; None if the template rewrites history. What precedes the first turn belongs to it."""
    before, spans = "", []
    for k, (role, text) in enumerate(turns):
        after = template(turns[: k + 1])
        if not after.startswith(before):
            return template(turns), None
        # The text starts where another text in its place first changes the output, and it is as
        # long as the output is longer than with no text.
        empty, marked = template([*turns[:k], (role, "")]), template([*turns[:k], (role, MARK)])
        start = _common(empty, marked)
        length = len(after) - len(empty)
        if after[:start] != empty[:start] or after[start + length :] != empty[start:]:
            start, length = len(after), 0  # the template drops or changes the text
        spans.append((role, len(before), len(after), start, start + length))
        before = after
    return before, spans


def format_turns(turns: list[Turn], template: Template, trained: tuple[str, ...]) -> tuple:
    text, spans = locate(turns, template)
    loss = [(s[3], s[4]) for s in spans or () if s[0] in trained]
    return len(turns), text, spans or [], loss, spans is None


def format_conversations(
    conversations: DataFrame,
    template: Template = chatml,
    trained: tuple[str, ...] = ("assistant",),
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row a conversation: OUTPUT's columns; positions are code points of `formatted`.

    template: any function from a list of (role, text) to the whole output; it is called for every
    prefix. Rows are ordered by turn (null
    first), then role and text, so ties and repeated rows, which count as turns, have one order. Null role or text: empty; bytes that are no UTF-8 become U+FFFD. Rows with a null id are one
    conversation. Other columns are not read. Empty input: no rows. A conversation is one training
    text, so its turns meet in one task; all else is dealt by conversation.
    """
    require(conversations, conv_id, turn, role, text)
    turns = conversations.select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(valid_text(F.col(role)), F.lit("")).alias("role"),
            F.coalesce(valid_text(F.col(text)), F.lit("")).alias("text"),
        ).alias("t"),
    )
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    schema = pa.schema(
        [
            ("conv_id", pa.int64()),
            ("n_turns", pa.int64()),
            ("formatted", pa.string()),
            ("spans", pa.list_(pa.struct([("role", pa.string()), *((x, pa.int64()) for x in ("start", "end", "text_start", "text_end"))]))),
            ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ("rewrites_history", pa.bool_()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, group in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n, out, spans, loss, rewrites = format_turns([(x["role"], x["text"]) for x in group.as_py()], template, trained)
                rows.append(
                    {
                        "conv_id": conv,
                        "n_turns": n,
                        "formatted": out,
                        "spans": [dict(zip(("role", "start", "end", "text_start", "text_end"), s, strict=True)) for s in spans],
                        "loss_spans": [{"start": a, "end": b} for a, b in loss],
                        "rewrites_history": rewrites,
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, schema)

    return grouped.mapInArrow(run, OUTPUT)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from chatml outputs
    and their loss spans alone."""
    import hashlib

    require(formatted, "conv_id", "formatted", "loss_spans")
    kinds = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}

    def digest(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                turns = parse_chatml(x["formatted"])
                loss = "".join(unescape(x["formatted"][s["start"] : s["end"]]) for s in x["loss_spans"])
                rows.append((x["conv_id"], len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss), len(x["formatted"])))
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, schema)
