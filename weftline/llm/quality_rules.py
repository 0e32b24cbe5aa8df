"""Quality rules, lines first: lines that break a rule go, then documents that lost too much go."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require, valid_text

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
# Fixed values of the line rules.
TERMINAL = (".", "!", "?", "…", "。", "！", "？", ":", ";", '"', "'", "”", "’", "»", ")")
BOILERPLATE = (
    "all rights reserved",
    "cookie policy",
    "enable javascript",
    "javascript is disabled",
    "lorem ipsum",
    "privacy policy",
    "terms of service",
    "terms of use",
    "use of cookies",
)
#: A line of menu entries has this share of separators to words; one of symbols that of symbols.
NAVIGATION_SHARE = 0.25
SYMBOL_SHARE = 0.25
MIN_WORDS = 50
MAX_REPEATED = 0.5
MAX_LOST = 0.5

OUTPUT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, n_lines long, n_failed_lines long, words_lost long, kept boolean, clean_text string"
)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    size = len(numbers)
    if size == n:
        return 0
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, n)
    pairs = ids[:-1] * size + ids[1:]
    if size > 2_000_000:  # else the codes of three words fit in 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    codes = pairs[:-1] * size + ids[2:]
    order = np.argsort(codes, kind="stable")
    same = codes[order[1:]] == codes[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def line_fails(line: str, n_words: int) -> str | None:
    """The first rule that a line with words breaks."""
    end = line.rstrip(SPACES)
    if (line.count("|") + line.count("»") + line.count("›")) >= max(2, NAVIGATION_SHARE * n_words):
        return "navigation"
    if sum(map(line.count, SYMBOLS)) + line.count("!!") >= max(3, SYMBOL_SHARE * n_words):
        return "symbols"
    if n_words >= 5 and line.upper() == line and line.lower() != line:
        return "shouting"
    if not end.endswith(TERMINAL):
        return "punctuation"
    low = line.lower()
    if any(x in low for x in BOILERPLATE):
        return "boilerplate"
    return None


def judge(text: str | None, min_words: int, max_repeated: float, max_lost: float) -> tuple:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    seen: set[str] = set()
    dup = lines = failed = lost = 0
    kept = []
    for line in text.split("\n"):
        count = len(line.encode("utf-8", "surrogatepass").split())
        if not count:
            kept.append(line)
            continue
        lines += 1
        if line in seen:
            dup += 1
        seen.add(line)
        if line_fails(line, count):
            failed += 1
            lost += count
        else:
            kept.append(line)
    repeat = repeated_words(words)
    base_failed = n < min_words or 100 * repeat > 100 * max_repeated * n
    ok = not base_failed and lost <= max_lost * n
    return (
        n,
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        dup,
        repeat,
        base_failed,
        lines,
        failed,
        lost,
        ok,
        "\n".join(kept) if failed else text,
    )


def clean_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_words: int = MIN_WORDS,
    max_repeated: float = MAX_REPEATED,
    max_lost: float = MAX_LOST,
) -> DataFrame:
    """One row for each row of docs: counts over the whole text, verdicts and the cleaned text.

    Lines with words that look like navigation, symbol junk or shouting, lack terminal punctuation
    or hold boilerplate are removed; a document is kept if it has min_words words, at most
    max_repeated of them in repeated three-word windows, and lost at most max_lost of them with its
    lines. Bytes that are no UTF-8 become U+FFFD. Null and empty texts have no words, all counts 0 and fail. Null ids stay null, repeated
    rows give a row each, other columns are not read. Empty input: no rows.
    """
    require(docs, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judge(t, min_words, max_repeated, max_lost) for t in batch.column(1).to_pylist()]
            columns = list(zip(*rows, strict=True)) or [()] * 11
            kinds = [pa.int64()] * 5 + [pa.bool_()] + [pa.int64()] * 3 + [pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=NAMES
            )

    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"), valid_text(F.col(text)).alias("text"))
    return ids.mapInArrow(run, OUTPUT)


NAMES = [x.split()[0] for x in OUTPUT.split(", ")]
