import random
import re

import pytest

from weftline.llm.license_scan import PERCENT, PHRASES, RARE, TEMPLATES, Template, scan_licenses


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def naive(texts):
    """Every template tried at every place."""
    all_words = [words_of(t) for t in texts]
    held = {}
    for words in all_words:
        for w in set(words):
            held[w] = held.get(w, 0) + 1
    known = [Template.of(*t) for t in TEMPLATES]
    out = []
    for words in all_words:
        base = [(i, label) for p, label in PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        notices = []
        for t in known:
            first = {w: t.words.index(w) for w in t.words}
            rare = sorted(first.values(), key=lambda i: (held.get(t.words[i], 0), i))[: min(RARE, (len(t.words) + 1) // 2)]
            for s in range(-len(t.words), len(words)):
                same = [0 <= s + i < len(words) and words[s + i] == w for i, w in enumerate(t.words)]
                if all(same[i] for i in t.mandatory) and 100 * sum(same[i] for i in rare) >= PERCENT * len(rare):
                    notices.append((t.label, s, sum(same) / len(same)))
        starts = [i for i, _ in base]
        labels = {label for _, label in base}
        out.append((len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {x[0] for x in notices})), max([0.0, *(x[2] for x in notices)])))
    return out


def test_against_brute_force(spark):
    rng = random.Random(11)
    plain = [re.sub(r"[\[\]]", "", t) for _, t in TEMPLATES]
    filler = ["the", "mit", "license", "version", "2", "cc", "by", "nc", "under", "apache", "x", "é", "general", "public"]
    texts = [None, "", "...", "MitK under the MIT licenſe", "MIT License under the"]
    for _ in range(250):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            words = rng.choice(plain).split()
            for _ in range(rng.randrange(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(filler)
            if rng.random() < 0.3:
                words = words[rng.randrange(4) :]
            parts += [rng.choice(filler) for _ in range(rng.randrange(0, 12))] + words
        texts.append(rng.choice([" ", ", ", "\n- "]).join(w.upper() if rng.random() < 0.2 else w for w in parts))
    texts += [texts[7]] * 3 + [("Released under the MIT License. " * 4000) + "cc-by-nc"]
    rows = [(i if i % 7 else None, t, {"a": 1}, "old", [1]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words map<string, int>, labels string, hits array<int>")
    found = scan_licenses(docs).collect()
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    key = lambda r: tuple(map(repr, r))
    got = sorted(((r["text"], *(r[n] for n in names)) for r in found), key=key)
    assert got == sorted(((t, *f) for t, f in zip(texts, naive(texts), strict=True)), key=key)
    assert all(r["words"] == {"a": 1} and r["hits"] == [1] for r in found)
    assert {"gpl-3", "bsd", "isc", "cc0"} <= {x for r in found for x in r["labels"].split(",")}
    assert scan_licenses(docs.limit(0)).count() == 0


def test_own_templates(spark):
    docs = spark.createDataFrame([(1, "You may copy this freely, Bob."), (2, "may copy this freely"), (3, "copy this")], "doc_id long, text string")
    found = scan_licenses(docs, phrases=[], templates=[("free", "you may [copy this] freely")]).orderBy("doc_id").collect()
    assert [(r["n_base"], r["labels"], r["score"]) for r in found] == [(0, "free", 1.0), (0, "free", 0.8), (0, "", 0.0)]
    assert found[1]["notices"][0]["first_word"] == -1
    with pytest.raises(ValueError):
        scan_licenses(docs, templates=[("none", "no phrase")])
