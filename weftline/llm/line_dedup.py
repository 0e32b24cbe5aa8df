"""Line dedup: passages of three lines or more that occur before are removed. Native.

Every three consecutive lines with a word are hashed (128 bits); windows that occur more than once
in the table are found with a count and the earliest place for each; all later occurrences go,
with the positions that overlapping windows cover merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, materialise, release_heaps, require

HAS_WORD = r"[^\x20\x09-\x0D]"


def _with_lines(docs: DataFrame, text: str) -> DataFrame:
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    return docs.withColumn("_lines", lines)


def _place(doc_id: Column, text_hash: Column, start: Column) -> Column:
    """Order of occurrences as one number, which a hash aggregate can take the minimum of: by id
    (null last), then the text's hash, then line. 64 + 30 + 31 bits."""
    whole = "decimal(38,0)"
    ident = F.coalesce(doc_id.cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)"), F.lit(str(2**64)).cast("decimal(20,0)")).cast(whole)
    low = F.shiftleft(F.pmod(text_hash, F.lit(1 << 30)), 31) + start
    return (ident * F.lit(1 << 61).cast("decimal(19,0)")).cast(whole) + low.cast("decimal(19,0)")


def line_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """_id, _th (the text's hash), _a and _b (the window's hash), _s and _e (its first and last line).

    Lines without a word belong to no window; white space around a line does not count. A document
    of one or two such lines has one window, of all its lines."""
    lines = _with_lines(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")), "_text")
    lines = lines.withColumns({"_th": F.xxhash64("_text"), "_marked": F.transform("_lines", lambda x, i: F.struct(i.alias("i"), F.btrim(x, F.lit(ASCII_SPACE)).alias("x")))})
    marked = F.filter("_marked", lambda m: F.length(m["x"]) > 0)
    hashed = lines.select(
        "_id", "_th", F.transform(marked, lambda m: F.struct(m["i"].alias("i"), F.xxhash64(m["x"]).alias("a"), F.xxhash64(F.lit(17), m["x"]).alias("b"))).alias("_h")
    ).where(F.size("_h") > 0)

    def window(h: Column, j: Column) -> Column:
        at = [F.get(h, j + k) for k in range(3)]
        last = F.coalesce(at[2]["i"], at[1]["i"], at[0]["i"])
        return F.struct(
            F.xxhash64(*[x["a"] for x in at]).alias("a"),
            F.xxhash64(F.lit(23), *[x["b"] for x in at]).alias("b"),
            at[0]["i"].alias("s"),
            last.alias("e"),
        )

    starts = F.sequence(F.lit(0), F.greatest(F.size("_h") - 3, F.lit(0)))
    return hashed.select("_id", "_th", F.explode(F.transform(starts, lambda j: window(F.col("_h"), j))).alias("w")).select(
        "_id", "_th", F.col("w.a").alias("_a"), F.col("w.b").alias("_b"), F.col("w.s").alias("_s"), F.col("w.e").alias("_e")
    )


def _deduped(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc (a struct of all columns of docs but the text), text (cleaned), n_lines, n_removed."""
    require(docs, doc_id, text)
    release_heaps(docs.sparkSession)
    rest = [docs[c] for c in docs.columns if c != text]
    rows = docs.select(F.struct(*rest).alias("doc"), docs[doc_id].alias("id"), docs[text].alias("text"))
    # Written once: 50 bytes a line, read by the count and by the join.
    windows = line_windows(rows, "id", "text").withColumn("_at", _place(F.col("_id"), F.col("_th"), F.col("_s").cast("long")))
    windows = materialise(windows, "windows")
    # One row a window and map task reaches the shuffle, however often it occurs; the join below
    # leaves a hot window to AQE, which splits the large side.
    repeated = windows.groupBy("_a", "_b").agg(F.count("*").alias("_n"), F.min("_at").alias("_first")).where("_n > 1")
    later = windows.join(repeated, ["_a", "_b"]).where("_at > _first")
    spans = later.groupBy("_id", "_th").agg(F.collect_set(F.struct("_s", "_e")).alias("_spans"))

    keyed = rows.withColumn("_key", F.xxhash64("text"))
    found = keyed.join(spans, F.col("id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_th")), "left")
    found = _with_lines(found, "text")
    worded = lambda lines: F.size(F.filter(lines, lambda x: x.rlike(HAS_WORD)))
    gone = F.array_distinct(F.flatten(F.transform("_spans", lambda s: F.sequence(s["_s"], s["_e"]))))
    left_over = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    found = found.withColumn("_gone", gone)
    found = found.withColumn(
        "_kept", F.when(F.col("_gone").isNotNull(), F.transform(left_over, lambda i: F.get(F.col("_lines"), i)))
    )
    found = found.withColumns(
        {"n_lines": worded(F.col("_lines")).cast("long"), "_left": F.when(F.col("_kept").isNotNull(), worded(F.col("_kept")))}
    )
    cleaned = F.when(F.col("_kept").isNull(), F.col("text")).when(F.col("_left") == 0, F.lit("")).otherwise(F.array_join("_kept", "\n"))
    removed = F.when(F.col("_kept").isNull(), F.lit(0)).otherwise(F.col("n_lines") - F.col("_left")).cast("long")
    return found.select("doc", cleaned.alias("text"), "n_lines", removed.alias("n_removed"))


def _columns(docs: DataFrame, text: str, without: tuple[str, ...] = ()) -> list[Column]:
    return [F.col("text").alias(c) if c == text else F.col("doc").getField(c).alias(c) for c in docs.columns if c not in without]


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the text cleaned, plus n_lines (lines with a word) and n_removed (of those).

    The earliest occurrence of a window (by id, null last, then line) stays, and lines covered by
    any later one go; lines without a word go only between removed ones. A text of which nothing
    was removed is unchanged, a null text stays null with zero lines; one of which all lines were
    removed becomes ''. Rows with the same id and the same text are one document and share its
    result. Rows with the same id and other texts are ordered by a hash of the text. Columns named
    n_lines or n_removed are replaced, other names cannot clash. Empty input: no rows.
    """
    return _deduped(docs, doc_id, text).select(*_columns(docs, text, ("n_lines", "n_removed")), "n_lines", "n_removed")


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = None) -> DataFrame:
    """docs, with its columns, as dedup_lines cleans it; rows of whose text nothing is left go. n_chars: a
    column that gets the new length, if docs has it."""
    kept = _deduped(docs, doc_id, text).where("n_removed = 0 or text != ''")
    length = F.length("text").cast(docs.schema[n_chars].dataType) if n_chars in docs.columns else None
    return kept.select(*[length.alias(c) if c == n_chars else x for c, x in zip(docs.columns, _columns(docs, text), strict=True)])
