"""Packing documents into training sequences with sum-of-squares online packing.

A document's ids (its tokens and an end token) are cut into full windows and a rest. The rest goes
to the fill level for which the sum of the squared counts of partly filled windows over all levels
becomes least; the counts are an array with one entry a level. Beyond max_open open windows, which
bounds memory, those of the levels with most windows are cut together into full ones, all others
stay; so are the windows still open at the end of a task, and what is left is cut at powers of two,
which need no padding.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, release_heaps, release_worker, require, valid_text

WINDOW = 4096
END_ID = 2
MAX_OPEN = 2048
#: Bytes of word ids that a worker remembers, until another operator runs in it; those of an entry besides
#: its word and ids.
CACHE, ENTRY = 96 << 20, 180

OUTPUT = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, `offset` long, ids binary"
)


#: Visible Latin-1 text without apostrophes, and the runs that the pre-tokeniser makes of it in lower
#: case: letters, single digits, the rest.
LATIN = re.compile("[!-&(-~¡-¬®-ÿ]+")
ASCII, ASCII_RUNS = re.compile(rb"[!-&(-~]+"), re.compile(rb"[a-z]+|[0-9]|[^a-z0-9]+")
LATIN_RUNS = re.compile("[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^a-z0-9ªµºß-öø-ÿ²³¹¼-¾]+")
PROBES = "The end. naïve, ÀB c'est 1a2 ½ #x! <|endoftext|> «Übung» ...!!? a_b İx ΣΑΣ, thand%%% 007 ªº ×÷"


def byte_letters() -> list[str]:
    """The letter of each byte in byte-level vocabularies: printable Latin-1 ones stand for themselves,
    the others for code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}
    return [rest.get(b, chr(b)) for b in range(256)]


class WordIds(dict):
    """Ids of a white-space free chunk of text, as little-endian 32-bit bytes.

    The vocabulary's normaliser and pre-tokeniser never look across white space, so a text's ids
    are those of its chunks one after the other; chunks repeat, so most need no encoding. Chunks of
    Latin-1 are cut into runs here and only new runs go to the vocabulary's merges; whether that is
    what the whole tokenizer does is probed first, else every chunk goes to it.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.bytes = 0
        self.encode, self.merge = tokenizer.encode, tokenizer.model.tokenize
        self.letters = byte_letters()
        self.fast = all(self.cut(w) == self.plain(w) for w in PROBES.split())

    def plain(self, text: str) -> bytes:
        return array("I", self.encode(text, add_special_tokens=False).ids).tobytes()

    def cut(self, text: str) -> bytes:
        if "<|" in text or not LATIN.fullmatch(text):
            return self.plain(text)
        runs = LATIN_RUNS.findall(text.lower())
        if len(runs) > 1 or runs[0] != text:
            return b"".join([self[r.encode()] for r in runs])
        return self.run("".join([self.letters[b] for b in text.encode()]))

    def run(self, letters: str) -> bytes:
        return array("I", [x.id for x in self.merge(letters)]).tobytes()

    def ascii(self, word: bytes) -> bytes:
        """As cut, for visible ASCII without apostrophes, whose letters stand for themselves."""
        runs = ASCII_RUNS.findall(word.lower())
        return b"".join([self[r] for r in runs]) if len(runs) > 1 or runs[0] != word else self.run(word.decode())

    def __missing__(self, word: bytes) -> bytes:
        fast = getattr(self, "fast", True)
        if fast and b"<|" not in word and ASCII.fullmatch(word):
            ids = self.ascii(word)
        else:
            text = word.decode("utf-8", "replace")
            ids = self.cut(text) if fast else self.plain(text)
        # The last half of the room is for single runs: the rest can be put together from them.
        if self.bytes < (CACHE if word.islower() and word.isalpha() else CACHE // 2) and len(word) <= 64:
            self[word] = ids
            self.bytes += ENTRY + len(word) + len(ids)
        return ids


@lru_cache(1)
def tokenizer_of(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def word_ids(path: str) -> WordIds:
    return WordIds(tokenizer_of(path))


class Levels:
    """counts[h]: windows filled to h; the windows themselves; which level takes a piece."""

    def __init__(self, window: int):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)
        self.windows: list[list] = [[] for _ in range(window + 1)]
        self.open = 0

    def level_for(self, size: int) -> int:
        """The fill level to add `size` to, 0 for a new window. Ties: the fullest."""
        counts = self.counts
        top = self.window - size
        used = np.flatnonzero(counts[1 : top + 1]) + 1
        after = counts[used + size]
        change = 2 * (after - counts[used]) + 2  # (a+1)^2 - a^2 + (c-1)^2 - c^2
        full = used == top
        change[full] = 1 - 2 * counts[top]  # a full window counts no more
        fresh = 2 * counts[size] + 1 if size < self.window else 0
        if not len(used):
            return 0
        best = len(used) - 1 - int(np.argmin(change[::-1]))
        return int(used[best]) if change[best] <= fresh else 0

    def take(self, level: int):
        self.counts[level] -= 1
        self.open -= 1
        return self.windows[level].pop()

    def put(self, level: int, window) -> None:
        self.counts[level] += 1
        self.open += 1
        self.windows[level].append(window)

    def drain(self, some: int) -> list:
        """At least `some` open windows, fullest first, of the levels with most of them; they are closed."""
        levels, found = [], 0
        for level in np.argsort(-self.counts, kind="stable").tolist():
            if found >= some or not self.counts[level]:
                break
            levels.append(level)
            found += int(self.counts[level])
        out = [w for level in sorted(levels, reverse=True) for w in self.windows[level]]
        for level in levels:
            self.counts[level], self.windows[level] = 0, []
        self.open -= found
        return out


class Packer:
    """Packs one task's documents; `rows` gets each piece once its window is closed."""

    def __init__(self, window: int, max_open: int, first_sequence: int):
        self.window, self.max_open, self.next = window, max_open, first_sequence
        self.levels = Levels(window)
        self.rows: list[tuple] = []

    def close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, total, self.next, at, ids))
            at += n
        self.next += 1

    def add(self, doc, ids: bytes) -> None:
        total = len(ids) // 4
        rest = total % self.window
        for start in range(0, total - rest, self.window):
            self.close([(doc, start, ids[4 * start : 4 * (start + self.window)], total)])
        if not rest:
            return
        piece = (doc, total - rest, ids[4 * (total - rest) :], total)
        level = self.levels.level_for(rest)
        pieces = [*self.levels.take(level), piece] if level else [piece]
        if level + rest == self.window:
            self.close(pieces)
        else:
            self.levels.put(level + rest, pieces)
            if self.levels.open > self.max_open:
                self.flush(False)

    def flush(self, last: bool) -> None:
        """Cut open windows together into full ones: all if `last`, and the partial one that is left is
        closed in powers of two; else half of max_open, and it stays open."""
        current: list[tuple] = []
        room = self.window
        for doc, start, ids, total in (p for w in self.levels.drain(self.levels.open if last else self.max_open // 2 + 1) for p in w):
            while ids:
                part, ids = ids[: 4 * room], ids[4 * room :]
                n = len(part) // 4
                current.append((doc, start, part, total))
                start += n
                room -= n
                if not room:
                    self.close(current)
                    current, room = [], self.window
        if current and not last:
            self.levels.put(self.window - room, current)
        while current:
            if not last:
                return
            size = sum(len(p[2]) // 4 for p in current)
            room, head = 1 << (size.bit_length() - 1), []
            while room:
                doc, start, ids, total = current.pop(0)
                n = min(room, len(ids) // 4)
                head.append((doc, start, ids[: 4 * n], total))
                if ids[4 * n :]:
                    current.insert(0, (doc, start + n, ids[4 * n :], total))
                room -= n
            self.close(head)


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    end_id: int = END_ID,
    max_open: int = MAX_OPEN,
) -> DataFrame:
    """The pieces of all documents with their places: OUTPUT's columns, ids as 32-bit integers.

    Each task packs the rows it reads, in one pass and without a shuffle; its sequences are
    numbered from its partition's number times 2**32, so they are unique over the table and the
    same again if a lost task is run anew. Bytes that are no UTF-8 become U+FFFD. A null or empty text is one piece, the end token alone.
    Repeated rows and null ids are documents of their own. Other columns are not read. Empty
    input: no rows. tokenizer_path: a `tokenizers` file whose pre-tokeniser splits at white space.
    """
    require(docs, doc_id, text)
    release_heaps(docs.sparkSession)
    end = np.asarray([end_id], "<u4").tobytes()
    names = [x.split()[0].strip("`") for x in OUTPUT.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = KEPT.setdefault(f"ids of {tokenizer_path}", None) or word_ids(tokenizer_path)
        KEPT[f"ids of {tokenizer_path}"] = known
        packer = Packer(window, max_open, TaskContext.get().partitionId() << 32)

        def out() -> pa.RecordBatch:
            columns = list(zip(*packer.rows, strict=True)) or [()] * len(kinds)
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        size = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = b"".join(map(known.__getitem__, (text.as_py() or "").encode().split())) + end
                packer.add(doc, ids)
                size += len(ids)
                if size > 1 << 24:
                    size = 0
                    yield out()
        packer.flush(True)
        yield out()
        release_worker(keep=f"ids of {tokenizer_path}")

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), valid_text(F.col(text)).alias("text")).mapInArrow(run, OUTPUT)
