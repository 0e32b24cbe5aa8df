"""Language identification of mixed-language text.

Each word's script (Unicode ranges) narrows the languages to those written in it; character n-grams
and whole words score the rest; Viterbi over the words, with a penalty for each switch, labels
spans. The document's language is the one with most letters in its spans.

Texts are taken as arrays of code points, many at a time: runs of letters, their n-grams and the
scores of all different runs come from array operations, and nothing is remembered in between.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import flat, hash_fraction, release_heaps, release_worker, require, slices, valid_text

UNKNOWN = "und"
#: Training rows: about so many a language, drawn by a hash of the id.
TRAIN_DOCS = 1500
SWITCH = 12.0
WORD_LIMIT = 6.0

# First code points of Unicode blocks, and the scripts they begin.
SCRIPTS = (
    (0x0000, "latin"),
    (0x0370, "greek"),
    (0x0400, "cyrillic"),
    (0x0530, "armenian"),
    (0x0590, "hebrew"),
    (0x0600, "arabic"),
    (0x0700, "other"),
    (0x0900, "devanagari"),
    (0x0980, "indic"),
    (0x0E00, "thai"),
    (0x0E80, "other"),
    (0x10A0, "georgian"),
    (0x1100, "hangul"),
    (0x1200, "other"),
    (0x1E00, "latin"),
    (0x1F00, "greek"),
    (0x2000, "other"),
    (0x3040, "kana"),
    (0x3100, "han"),
    (0xA000, "other"),
    (0xAC00, "hangul"),
    (0xD7B0, "other"),
    (0xF900, "han"),
    (0xFB00, "other"),
    (0x20000, "han"),
)
STARTS = np.array([a for a, _ in SCRIPTS])
NAMES = sorted({name for _, name in SCRIPTS})
SCRIPT_OF = np.array([NAMES.index(name) for _, name in SCRIPTS])
#: Kinds of what is counted: n-grams, whole words, letters of a script.
GRAM, WORD, SCRIPT = 0, 1, 2
#: No letters are beyond this code point.
LIMIT = 0x40000
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)


@lru_cache(1)
def letters_of() -> tuple[np.ndarray, np.ndarray]:
    """For each code point whether it is a letter (Unicode categories L*), and its lower case, if that is
    one code point. The same for all models."""
    every = [chr(c) for c in range(LIMIT)]
    low = np.fromiter((ord(y) if len(y := x.lower()) == 1 else i for i, x in enumerate(every)), np.uint32, LIMIT)
    return np.fromiter(map(str.isalpha, every), bool, LIMIT), low


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * ODD[3]
    x = (x ^ (x >> np.uint64(29))) * ODD[4]
    return x ^ (x >> np.uint64(32))


class Runs:
    """The runs of letters in some texts, in order. chunks: white-space free pieces of each text; chunk:
    that of each run; n: letters of each run; unique, which: its different spellings in lower case."""

    def __init__(self, texts: list[str]):
        letter, lower = letters_of()
        points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.minimum(points, LIMIT - 1)
        ends = np.cumsum([len(t) + 1 for t in texts])
        free = (points != 32) & ((points < 9) | (points > 13))
        begins = free.copy()
        begins[1:] &= ~free[:-1]
        number = np.cumsum(begins)
        self.chunks = np.diff(np.append(0, number[ends - 1])) if len(texts) else np.zeros(0, np.int64)
        is_letter = letter[points]
        self.first = np.flatnonzero(is_letter & ~np.append(False, is_letter[:-1]))
        stop = np.flatnonzero(is_letter & ~np.append(is_letter[1:], False)) + 1
        self.n = stop - self.first
        self.chunk = number[self.first] - 1
        self.low = lower[points].astype(np.uint64)
        self.points = points
        if not len(self.first):
            self.unique = self.which = np.zeros(0, np.int64)
            self.codes = np.zeros(0, np.uint64)
            return
        at = np.flatnonzero(is_letter)
        begin = np.cumsum(self.n) - self.n
        place = np.arange(len(at)) - np.repeat(begin, self.n)
        with np.errstate(over="ignore"):
            codes = np.add.reduceat(scramble(self.low[at] + (place.astype(np.uint64) << np.uint64(20))), begin)
            codes = scramble(codes + self.n.astype(np.uint64) * ODD[0])
        self.codes, self.unique, self.which = np.unique(codes, return_index=True, return_inverse=True)

    def scripts(self) -> np.ndarray:
        """Number of the script of each different run's first letter."""
        return SCRIPT_OF[np.searchsorted(STARTS, self.points[self.first[self.unique]], "right") - 1]

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the three-letter n-grams, edges included, of all different runs, and where each run's begin:
        one around each letter."""
        first, n = self.first[self.unique], self.n[self.unique]
        begin = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(begin, n)
        at = np.repeat(first, n) + place
        left = np.where(place == 0, np.uint64(1), self.low[at - 1])
        right = np.where(place == np.repeat(n - 1, n), np.uint64(2), self.low[np.minimum(at + 1, len(self.low) - 1)])
        with np.errstate(over="ignore"):
            return scramble(left * ODD[0] + self.low[at] * ODD[1] + right * ODD[2]), begin


class Model:
    """languages; hashes and table: for each n-gram and word its centred log probabilities by language,
    the last row for unknown ones; written: the languages of each script. A dense table: n-grams of the
    training rows times languages."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        """counts: rows of (language's number, kind, code as a signed integer, n)."""
        self.languages = languages
        k = len(languages)
        lang, kind, code, n = counts.T if len(counts) else np.zeros((4, 0), np.int64)
        hashes, tables = [], []
        for which in (GRAM, WORD):  # two distributions
            mine = kind == which
            found, row = np.unique(code[mine].view(np.uint64), return_inverse=True)
            table = np.zeros((len(found), k))
            np.add.at(table, (row, lang[mine]), n[mine])
            table = np.log((table + 0.5) / (table.sum(0) + 0.5 * max(1, len(found))))
            hashes.append(found)
            tables.append((table - table.mean(1, keepdims=True)).astype(np.float32) if k else table.astype(np.float32))
        every = np.concatenate(hashes)
        order = np.argsort(every, kind="stable")
        self.hashes = every[order]
        self.table = np.concatenate([*tables, np.zeros((1, k), np.float32)])[np.append(order, len(every))]
        # A language is written in the scripts that hold a hundredth of its letters.
        share = np.zeros((len(NAMES), k))
        mine = kind == SCRIPT
        np.add.at(share, (code[mine], lang[mine]), n[mine])
        self.written = 100 * share >= np.maximum(share.sum(0), 1)
        self.written[~self.written.any(1)] = True  # no language is: all may be

    def rows(self, codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, codes), max(0, len(self.hashes) - 1))
        return np.where(self.hashes[at] == codes, at, len(self.hashes)) if len(self.hashes) else np.zeros(len(codes), np.int64)

    def score(self, runs: Runs) -> np.ndarray:
        """A row for each different run of letters, its scores at most WORD_LIMIT apart."""
        codes, begin = runs.grams()
        out = np.add.reduceat(self.table[self.rows(codes)], begin, axis=0) + self.table[self.rows(runs.codes)]
        out = np.where(self.written[runs.scripts()], out, -np.inf)
        return np.maximum(out - out.max(1, keepdims=True), -WORD_LIMIT)


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The labels of the words with the largest sum of scores less penalties; ties: the label kept,
    then the first."""
    n, k = scores.shape
    total = scores.sum(0, dtype=np.float64)
    best = int(np.argmax(total))
    # If no other language gains more than half a penalty on `best` over any stretch, no labelling
    # with switches can beat `best` throughout: m stretches of others cost m - 1 switches at least.
    lead = np.cumsum(scores - scores[:, best : best + 1], axis=0, dtype=np.float64)
    low = np.minimum(np.minimum.accumulate(lead, axis=0), 0.0)
    if (lead - np.concatenate([np.zeros((1, k)), low[:-1]])).max(initial=0.0) <= penalty / 2:
        return np.full(n, best, np.int64)
    value = [float(x) for x in scores[0]]
    back = np.empty((n, k), np.int64)
    back[0] = range(k)
    for t, row in enumerate(scores.tolist()):
        if not t:
            continue
        top = max(value)
        source, cut = value.index(top), top - penalty
        here = back[t]
        for j in range(k):
            if value[j] >= cut:
                here[j] = j
                value[j] += row[j]
            else:
                here[j] = source
                value[j] = cut + row[j]
    labels = np.empty(n, np.int64)
    label = value.index(max(value))
    for t in range(n - 1, -1, -1):
        labels[t] = label
        label = back[t, label]
    return labels


def label(texts: list[str], model: Model, penalty: float = SWITCH) -> list[tuple[str, float, list[tuple]]]:
    """Of each text the language, the share of letters in its spans, and the spans (language, first word,
    words)."""
    languages = model.languages
    nothing = (UNKNOWN, 0.0, [])
    runs = Runs(texts)
    if not languages or not len(runs.first):
        return [nothing] * len(texts)
    total = int(runs.chunks.sum())
    letters = np.bincount(runs.chunk, weights=runs.n, minlength=total)
    values = np.zeros((total, len(languages)), np.float32)
    heads = np.flatnonzero(np.append(True, runs.chunk[1:] != runs.chunk[:-1]))
    values[runs.chunk[heads]] = np.add.reduceat(model.score(runs)[runs.which], heads, axis=0)
    found, end = [], 0
    for n in runs.chunks.tolist():
        start, end = end, end + n
        mine = letters[start:end]
        if not mine.any():
            found.append(nothing)
            continue
        labels = viterbi(values[start:end], penalty)
        if (labels == labels[0]).all():
            found.append((languages[int(labels[0])], 1.0, [(languages[int(labels[0])], 0, n)]))
            continue
        shares = np.bincount(labels, weights=mine, minlength=len(languages))
        spans, at = [], 0
        for x, group in groupby(labels.tolist()):
            k = sum(1 for _ in group)
            spans.append((languages[x], at, k))
            at += k
        best = int(np.argmax(shares))
        found.append((languages[best], float(shares[best] / mine.sum()), spans))
    return found


def count(texts: list[str]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, codes, numbers of occurrences) of n-grams, words and scripts in some texts."""
    runs = Runs(texts)
    if not len(runs.first):
        return []
    often = np.bincount(runs.which)
    codes, begin = runs.grams()
    n = runs.n[runs.unique]
    grams, which = np.unique(codes, return_inverse=True)
    letters = np.bincount(runs.scripts(), weights=often * n, minlength=len(NAMES)).astype(np.int64)
    return [
        (GRAM, grams.view(np.int64), np.bincount(which, weights=np.repeat(often, n)).astype(np.int64)),
        (WORD, runs.codes.view(np.int64), often),
        (SCRIPT, np.flatnonzero(letters), letters[letters > 0]),
    ]


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", train_docs: int = TRAIN_DOCS, seed: int = 11) -> Model:
    """A model of all languages of docs, from about train_docs whole texts of each (all, if there are
    fewer), with all their n-grams. Rows with null lang or text are left out; without any, the model
    knows no language and labels everything 'und'. Counts are summed by Spark; the driver gets a row
    for each language and n-gram of the training rows."""
    require(docs, doc_id, text, lang)
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    # Numbers and shares are literal maps, so that no text is shuffled by its language.
    sizes = known.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n")).orderBy("lang").collect()
    if not sizes:
        return Model([], np.zeros((0, 4), np.int64))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], train_docs / r["n"])])
    number = F.create_map(*[F.lit(x) for i, r in enumerate(sizes) for x in (r["lang"], i)])
    drawn = hash_fraction(F.col(doc_id), seed) < F.element_at(share, F.col(lang))
    sample = known.where(drawn).select(F.element_at(number, F.col(lang)).alias("_lang"), valid_text(F.col(text)).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = batch.column(1), batch.column(0).to_numpy()
            for i in np.unique(langs):
                mine = texts.filter(pa.array(langs == i))
                for a, b in slices(flat(mine)[1]):
                    for kind, codes, n in count(mine.slice(a, b - a).to_pylist()):
                        whole = [np.full(len(codes), i, np.int32), np.full(len(codes), kind, np.int32), codes, n]
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(whole, KINDS, strict=True)], names=["lang", "kind", "code", "n"])
        release_worker()

    counted = sample.mapInArrow(run, "lang int, kind int, code long, n long").groupBy("lang", "kind", "code").agg(F.sum("n").alias("n")).toArrow()
    return Model([r["lang"] for r in sizes], np.stack([counted.column(c).to_numpy().astype(np.int64) for c in ("lang", "kind", "code", "n")], 1))


KINDS = (pa.int32(), pa.int32(), pa.int64(), pa.int64())
FOUND = "lang_pred string, score double, spans array<struct<lang:string,first:int,words:int>>"
SPAN = pa.struct([("lang", pa.string()), ("first", pa.int32()), ("words", pa.int32())])


def labelled(docs: DataFrame, model: Model, text: str = "text", penalty: float = SWITCH, keep: list[str] | None = None) -> DataFrame:
    """doc, a struct of the columns of docs (or those in keep), whose names then cannot clash, and the
    columns of FOUND: language, share of the letters that its spans hold, and spans of every row's
    whole text.

    'und' with score 0 and no spans: null text, text without a letter, or a model without
    languages. A text in scripts that no language is written in gets the language its n-grams fit
    best; ties go to the first language by code point. Null ids and repeated rows are rows like
    others. Empty input: no rows.
    """
    require(docs, text)
    release_heaps(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as many rows as the training texts have n-grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for a, b in slices(flat(batch.column(1))[1]):
                found = label([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()], model, penalty)
                spans = [s for x in found for s in x[2]]
                parts = [pa.array([s[i] for s in spans], SPAN.field(i).type) for i in range(3)]
                ends = np.cumsum([0, *(len(x[2]) for x in found)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([x[0] for x in found], pa.string()),
                        pa.array([x[1] for x in found], pa.float64()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(parts, fields=list(SPAN))),
                    ],
                    names=["doc", "lang_pred", "score", "spans"],
                )
        release_worker()

    packed = docs.select(F.struct(*[docs[c] for c in keep or docs.columns]).alias("doc"), valid_text(docs[text]).alias("text"))
    return packed.mapInArrow(run, StructType([packed.schema["doc"], *StructType.fromDDL(FOUND).fields]))


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", penalty: float = SWITCH) -> DataFrame:
    """doc_id, lang_pred, score, spans of every row, as `labelled` finds them; other columns are not read."""
    require(docs, doc_id, text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return labelled(rows, model, penalty=penalty, keep=["doc_id"]).select("doc.doc_id", "lang_pred", "score", "spans")
