import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from weftline.llm.fill_in_middle import CODE_POINT, UnitMatcher, check_marks, cut, fill_in_middle, restore


def naive(doc_id, text, unit=CODE_POINT, seed=1):
    ends = [0, *(m.end() for m in re.finditer(unit, text))]
    n = len(ends) - 1
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, plain, spm = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    low, high = sorted((ends[a % (n + 1)], ends[b % (n + 1)]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or plain % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:low], text[low:high], text[high:]
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if spm % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return n, form, low, high - low, out


@pytest.mark.parametrize("unit", [CODE_POINT, r"\w+", r"[^\n]+\n?", r"ab|a|b", r"(?:ab)+?"])
def test_matcher(unit):
    rng = random.Random(5)
    matcher = UnitMatcher(unit)
    for size in [*range(40), 255, 256, 257, 511, 513, 5000]:
        text = "".join(rng.choice("aab b\né𝄞") for _ in range(size))
        ends = [0, *(m.end() for m in re.finditer(unit, text))]
        n = len(ends) - 1
        a, b = rng.randrange(1 << 32), rng.randrange(1 << 32)
        low, high = sorted((a % (n + 1), b % (n + 1)))
        assert cut(text, matcher, a, b) == (n, ends[low], ends[high])
    with pytest.raises(ValueError):
        UnitMatcher("a*")


def test_marks():
    check_marks(("<P>", "<S>", "<M>"))
    for marks in (("", "b", "c"), ("a", "ab", "c"), ("xy", "yz", "q"), ("aa", "b", "c")):
        with pytest.raises(ValueError):
            check_marks(marks)


@pytest.mark.parametrize("unit", [CODE_POINT, r"\S+"])
def test_forms(spark, unit):
    rng = random.Random(9)
    texts = [None, "", "a", "𝄞é́<", "<P> held", "end <", "퟿\x00b", "long é " * 60_000]
    texts += ["".join(rng.choice("ab <>PSM\né𝄞") for _ in range(rng.randrange(1, 600))) for _ in range(300)]
    rows = [(i if i % 9 else None, t, {"k": i}, "kept", "x") for i, t in enumerate(texts)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, bag map<string, int>, cut string, n string")
    found = fill_in_middle(docs, unit=unit).withColumn("again", restore(F.col("form"), F.col("output"))).collect()
    assert len(found) == len(rows)
    key = lambda r: tuple(map(repr, r))
    got = sorted(((r["doc_id"], r["text"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in found), key=key)
    assert got == sorted(((i, t, *naive(i, t or "", unit)) for i, t, *_ in rows), key=key)
    assert all(r["again"] == (r["text"] or "") and r["cut"] == "kept" and r["bag"] for r in found)
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}
    assert fill_in_middle(docs.limit(0)).count() == 0


def test_invalid_bytes(spark):
    docs = spark.sql("select 3L as doc_id, cast(X'ff41' as string) as text")
    row = fill_in_middle(docs).select("n", restore(F.col("form"), F.col("output")).alias("again")).first()
    assert row["n"] == 2 and row["again"] == "�A"
