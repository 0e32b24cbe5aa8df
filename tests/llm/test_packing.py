import os

import numpy as np
from tokenizers import Tokenizer

from weftline.llm.packing import Levels, pack_documents, word_ids
from weftline.llm.queries import tokenizer_path

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ODD = ["", None, "a" * 9000, "It's  THE\u00a0end.\x1c<|endoftext|> é e\u0301 ẞ İ ΣΑΣ, ΑΣ. 'll don't 12,3", "ok.,\n\n\tx ,. ... , ", "word " * 12_000, "…x. Ünïcode, naïve. ÀB."]


def expected(text):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def check(docs, pieces):
    """Exact round trip, gapless sequences; returns tokens and padding."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        ids = np.frombuffer(bytes(p["ids"]), "<u4").tolist()
        assert len(ids) == p["length"] > 0
        by_doc.setdefault(p["doc_id"], []).append((p["start"], ids, p["doc_tokens"]))
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for doc, text in docs:
        ids = [x for _, part, _ in sorted(by_doc[doc]) for x in part]
        assert ids == expected(text)
        assert {t for _, _, t in by_doc[doc]} == {len(ids)}
    total = padding = 0
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
        total += at
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    return total, padding


def test_round_trip(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    docs += [(-1 - i, t) for i, t in enumerate(ODD)]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, start long")
    total, padding = check(docs, pack_documents(frame, tokenizer_path()).collect())
    assert padding <= 0.02 * total


def test_open_windows_are_bounded(spark):
    docs = [(i, "x " * (i * 37 % 900)) for i in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    total, padding = check(docs, pack_documents(frame, tokenizer_path(), max_open=5).collect())
    assert padding <= 0.02 * total
    assert pack_documents(frame.limit(0), tokenizer_path()).count() == 0


def test_level_minimises_sum_of_squares():
    rng, levels = np.random.default_rng(0), Levels(16)
    for _ in range(500):
        size = int(rng.integers(1, 16))
        counts = levels.counts.tolist()

        def after(level):
            c = counts[:]
            if level:
                c[level] -= 1
            if level + size < 16:
                c[level + size] += 1
            return sum(x * x for x in c)

        options = [h for h in range(17 - size) if h == 0 or counts[h]]
        level = levels.level_for(size)
        assert after(level) == min(map(after, options))
        if level:
            levels.take(level)
        if level + size < 16:
            levels.put(level + size, [])


def test_words_are_what_the_tokenizer_says():
    words = word_ids(tokenizer_path())
    for text in ODD:
        ids = b"".join(words[w] for w in (text or "").encode().split())
        assert np.frombuffer(ids, "<u4").tolist() == expected(text)[:-1]
