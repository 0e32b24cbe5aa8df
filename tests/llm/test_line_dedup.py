import random
import time

from weftline.llm.line_dedup import dedup_lines


def brute(docs):
    """docs: distinct (id, text), text not null. The kept lines, line by line."""
    seen, out = set(), {}
    for ident, text in sorted(docs, key=lambda d: (d[0] is None, d[0])):
        lines = text.split("\n")
        worded = [i for i, x in enumerate(lines) if x.strip(" \t\x0b\x0c\r")]
        gone = set()
        for k in range(max(1, len(worded) - 2) if worded else 0):
            part = worded[k : k + 3]
            window = tuple(lines[i].strip(" \t\x0b\x0c\r") for i in part)
            if window in seen:
                gone |= set(range(part[0], part[-1] + 1))
            seen.add(window)
        left = [x for i, x in enumerate(lines) if i not in gone]
        out[ident] = text if not gone else "" if not any(x.strip(" \t\x0b\x0c\r") for x in left) else "\n".join(left)
    return out


def test_against_brute_force(spark):
    rng = random.Random(2)
    docs = [(i, "\n".join(rng.choice(["a b", "c.", " c.", "d e", "f", "", "g h i"]) for _ in range(rng.randrange(0, 9)))) for i in range(120)]
    docs += [(None, "x\ny\nz\nw")]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_lines long")
    found = {r["doc_id"]: r["text"] for r in dedup_lines(frame).collect()}
    assert found == brute(docs)


def test_cases(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, None), (4, ""), (1, "a\nb\nc\nd"), (5, "a\nb\nc"), (6, "q\nq\nq\nq\nq")]
    found = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((tuple(r) for r in found.collect()), key=str)
    assert got == sorted(
        [(1, "a\nb\nc\nd", 4, 0), (2, "x\ny", 5, 3), (3, None, 0, 0), (4, "", 0, 0), (1, "a\nb\nc\nd", 4, 0), (5, "", 3, 3), (6, "q", 5, 4)], key=str
    )
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_text(spark):
    text = "\n".join(f"line {i % 9000}" for i in range(60_000))
    began = time.time()
    row = dedup_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["text"] == "\n".join(f"line {i}" for i in range(9000))
    assert time.time() - began < 60
