"""Fill-in-middle: a text is cut at two of its units' ends and its parts change places.

A text is matched twice, from left to right. The first pass counts its units; two ranks are drawn
from 0 to that number, and the second pass advances to both. Matches are taken lazily, in runs of
units as long as runs fit and singly from there on: no list of units is ever held.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import require

#: The default unit: a code point.
CODE_POINT = r"(?s:.)"
#: Units a run.
RUNS = (256, 16, 1)
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
PERCENT_PLAIN, PERCENT_SPM = 10, 20


class UnitMatcher:
    """Lazy left-to-right matches of a unit, a regular expression; what lies between two units goes with
    the later one, what follows the last unit is no unit's. Raises if a unit can be empty."""

    def __init__(self, unit: str = CODE_POINT):
        if re.compile(unit).match(""):
            raise ValueError("a unit must not be empty")
        # Any character that no unit begins at, then a unit; neither is tried another way later.
        once = unit if unit == CODE_POINT else f"(?>(?:(?!{unit})(?s:.))*+(?:{unit}))"
        self.runs = [(k, re.compile(f"(?:{once}){{{k}}}" if once != unit else f"{unit}{{{k}}}").match) for k in RUNS]

    def steps(self, text: str, at: int, most: int | None = None) -> Iterator[tuple[int, int]]:
        """(units, end) of one run after another from `at` on, `most` units in all if so many follow."""
        left = most
        for k, match in self.runs:
            while (left is None or left >= k) and (found := match(text, at)):
                at = found.end()
                left = left - k if left is not None else None
                yield k, at

    def count(self, text: str) -> int:
        return sum(k for k, _ in self.steps(text, 0))

    def advance(self, text: str, at: int, units: int) -> int:
        """Where the last of so many units from `at` on ends; units are as many as follow, at most."""
        for _, at in self.steps(text, at, units):
            pass
        return at


def cut(text: str, matcher: UnitMatcher, a: int, b: int) -> tuple[int, int, int]:
    """Number of units, and the ends of prefix and middle (in code points), from two drawn numbers."""
    n = matcher.count(text)
    low, high = sorted((a % (n + 1), b % (n + 1)))
    first = matcher.advance(text, 0, low)
    return n, first, matcher.advance(text, first, high - low)


def check_marks(marks: tuple[str, ...]) -> None:
    """Raises unless the marks can be found again: none is empty, within another or overlaps one's end."""
    for a in marks:
        for b in marks:
            if not a or (a is not b and a in b) or any(a.endswith(b[:k]) for k in range(1, len(b)) if k < len(a)):
                raise ValueError(f"marks {a!r} and {b!r} can be mistaken for one another")


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the seed and the id: groups of eight digits of a SHA-256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    unit: str = CODE_POINT,
    seed: int = 1,
    percent_plain: int = PERCENT_PLAIN,
    percent_spm: int = PERCENT_SPM,
    marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE),
) -> DataFrame:
    """docs with n (units), form (plain, psm or spm), prefix_chars and middle_chars (code points, null if
    plain) and output (the text in its form), in place of columns of these names.

    What is drawn depends on the seed and the id alone: reruns and repeated rows agree, a null id counts
    as an empty one. A null text is an empty one; a text that is empty, holds a mark or is drawn so stays
    plain. Bytes that are no UTF-8 become U+FFFD first. Other columns, of any type, come through as they
    are. Empty input: no rows. A task holds a batch of texts (spark.sql.execution.arrow.maxRecordsPerBatch)
    and one text's numbers besides; very long texts take no more.
    """
    require(docs, doc_id, text)
    check_marks(marks)
    matcher = UnitMatcher(unit)
    fields = pa.struct([("n", pa.int64()), ("first", pa.int64()), ("second", pa.int64())])

    @F.arrow_udf("n long, first long, second long")
    def cuts(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, a, b in batches:
            found = [cut(texts[i].as_py(), matcher, a[i].as_py(), b[i].as_py()) for i in range(len(texts))]
            columns = zip(*found, strict=True) if found else ((), (), ())
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=list(fields))

    p, s, m = map(F.lit, marks)
    named = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.make_valid_utf8(F.coalesce(docs[text].cast("string"), F.lit(""))).alias("text"), *[h.alias(f"h{k + 1}") for k, h in enumerate(draws(docs[doc_id], seed))])
    held = F.col("text").contains(p) | F.col("text").contains(s) | F.col("text").contains(m)
    plain = (F.col("text") == "") | held | (F.col("h3") % 100 >= 100 - percent_plain)
    named = named.withColumn("form", F.when(plain, PLAIN).when(F.col("h4") % 100 < percent_spm, SPM).otherwise(PSM))
    at = named.withColumn("cut", cuts("text", "h1", "h2"))
    first, second = F.col("cut.first"), F.col("cut.second")
    part = lambda begin, length: F.substr("text", (begin + 1).cast("int"), length.cast("int"))
    prefix, middle = part(F.lit(0), first), part(first, second - first)
    suffix = F.substr("text", (second + 1).cast("int"))
    output = F.when(F.col("form") == PLAIN, F.col("text")).when(F.col("form") == PSM, F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    cut_up = F.col("form") != PLAIN
    new = {"n": F.col("cut.n"), "form": F.col("form"), "prefix_chars": F.when(cut_up, first), "middle_chars": F.when(cut_up, second - first), "output": output}
    return at.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns if c not in new], *[v.alias(k) for k, v in new.items()])


def restore(form: Column, output: Column, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that was cut, from its output and form alone."""
    p, s, m = marks
    before = lambda x, mark: F.substring_index(x, mark, 1)
    after = lambda x, mark: F.substr(x, F.instr(x, mark) + F.lit(len(mark)))
    psm = F.concat(before(after(output, p), s), after(output, m), before(after(output, s), m))
    spm = F.concat(before(after(output, p), m), after(output, m), before(after(output, s), p))
    return F.when(form == PLAIN, output).when(form == PSM, psm).otherwise(spm)
