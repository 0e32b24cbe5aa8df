import random
import re

from weftline.llm.quality_rules import clean_lines, judge, repeated_words


def naive_repeats(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    return len({i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)})


def test_repeats():
    rng = random.Random(3)
    for _ in range(300):
        words = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randrange(0, 25))]
        assert repeated_words(words) == naive_repeats(words)


def test_counts():
    text = "One two\u00a0three, four.\n\x0bOne | two | Three |\nOne two\u00a0three, four.\n \nA#B $5 %"
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, chars, symbols, dup, repeat, *_ = judge(text, 50, 0.5, 0.5)
    assert n == len(words) and chars == sum(map(len, words))
    assert symbols == sum(c in "#*$%&|<>" for c in text) and dup == 1
    assert repeat == naive_repeats(words)


def test_verdicts(spark):
    prose = "\n".join(f"{i}th sentence{i} tells plain{i} and decent{i} readers{i} about {i * i} things{i}." for i in range(20))
    menu = "\n".join(f"Home{i} | About{i} | Shop{i} | Login{i} |" for i in range(20))
    rows = [(1, prose), (2, menu), (3, prose + "\nAll rights reserved."), (4, None), (5, ""), (6, "same words again. " * 100), (None, prose), (1, prose)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, kept int")
    found = [(r["doc_id"], r["kept"], r["n_failed_lines"]) for r in clean_lines(frame).collect()]
    assert found == [(1, True, 0), (2, False, 20), (3, True, 1), (4, False, 0), (5, False, 0), (6, False, 0), (None, True, 0), (1, True, 0)]
    assert clean_lines(frame.limit(0)).count() == 0
    kept = clean_lines(frame).where("doc_id = 3").first()["clean_text"]
    assert kept == prose
