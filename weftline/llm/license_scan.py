"""Licence scans: notices found by their rarest words and the distances between these. Native.

Templates are indexed by their rarest words (by the documents that hold them): word, template,
position. A text's words that are in this index give places at which a template would begin; a
place is kept where half of the template's rare words stand where they should and every mandatory
word does. Phrases are found exactly, by the rarest word of each.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import require

# Phrases and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Notices by label, the mandatory phrases in brackets. Wordings are those of the licences.
TEMPLATES = (
    ("mit", "released [under the mit license]"),
    ("mit", "[permission is hereby granted free of charge] to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("isc", "[permission to use copy modify and or distribute this software for any purpose] with or without fee is hereby granted"),
    ("apache-2", "licensed under the [apache license version 2] 0"),
    ("bsd", "[redistribution and use in source and binary forms] with or without modification are permitted provided that the following conditions are met"),
    ("bsd-3", "names of its contributors may be used to [endorse or promote products derived from this software] without specific prior written permission"),
    ("gpl-2", "licensed under the [gnu general public license version 2]"),
    ("gpl-3", "licensed under the [gnu general public license version 3]"),
    ("gpl", "modify it under the terms of the [gnu general public license] as published by the free software foundation"),
    ("lgpl", "modify it under the terms of the [gnu lesser general public license] as published by the free software foundation"),
    ("agpl-3", "licensed under the [gnu affero general public license version 3]"),
    ("mpl-2", "this source code form is subject to the terms of the [mozilla public license v 2 0]"),
    ("epl-2", "made available under the terms of the [eclipse public license] 2 0"),
    ("bsl-1", "distributed under the [boost software license version 1 0]"),
    ("unlicense", "this is free and [unencumbered software released into the public domain]"),
    ("cc0", "released under [cc0 1 0 universal] public domain dedication"),
    ("cc-by-nc", "licensed under [cc by nc] 4 0"),
    ("cc-by-sa", "licensed under [cc by sa] 4 0"),
    ("cc-by-nc", "licensed under a [creative commons attribution noncommercial] 4 0 international license"),
    ("cc-by-sa", "licensed under a [creative commons attribution sharealike] 4 0 international license"),
)

#: Words of a template that are looked up, half of its words at most, and the percentage of them that has to stand in place.
RARE, PERCENT = 6, 50
#: What lies between two words, once A-Z are in lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The one character beyond A-Z whose lower case is an ASCII letter; any other letter that is none does in its place.
KELVIN, OTHER = "K", "é"
#: A place as one number: the template's, then where it begins. A text has fewer words than this.
PLACES = 1 << 40


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    mandatory: tuple[int, ...]

    @staticmethod
    def of(label: str, text: str) -> Template:
        words, mandatory, inside = [], [], False
        for word in re.findall(r"\[|\]|[^\[\] ]+", text):
            if word in "[]":
                inside = word == "["
            else:
                mandatory += [len(words)] * inside
                words.append(word)
        if not mandatory:
            raise ValueError(f"a template without a mandatory phrase: {text!r}")
        return Template(label, tuple(words), tuple(mandatory))


def words_of(text: Column) -> Column:
    """The words of a text, A-Z in lower case; null has none."""
    whole = F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit(KELVIN), F.lit(OTHER))
    return F.array_remove(F.split(F.lower(whole), BETWEEN, -1), "")


def document_counts(words: DataFrame, vocabulary: Sequence[str]) -> dict[str, int]:
    """In how many rows each of the words occurs: as many numbers as the vocabulary has words."""
    found = words.select(F.explode(F.array_distinct(F.filter("words", lambda w: w.isin(*vocabulary)))).alias("word"))
    counts = {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return {w: counts.get(w, 0) for w in vocabulary}


def rarest(words: Sequence[str], counts: dict[str, int], most: int) -> list[tuple[str, int]]:
    """The `most` rarest words, which is the highest inverse frequency first, then by position; with the position of their first place."""
    first = {w: words.index(w) for w in words}
    return sorted(first.items(), key=lambda x: (counts[x[0]], x[1]))[:most]


def _literal(rows: Sequence[tuple], kind: str) -> Column:
    """A constant array of structs; kind: their fields."""
    names = [x.split(":")[0] for x in kind.split(", ")]
    return F.from_json(F.lit(json.dumps([dict(zip(names, row, strict=True)) for row in rows])), f"array<struct<{kind}>>")


def scan_licenses(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    phrases: Sequence[tuple[str, str]] = PHRASES,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    rare: int = RARE,
    percent: int = PERCENT,
) -> DataFrame:
    """docs with n_words, n_base (places of phrases), first_word and last_word (the smallest and the largest
    word a phrase begins at, null without one), base_labels, labels (those of templates too; distinct,
    sorted, comma-joined), notices (label, first word and score of each place of a template) and score
    (the largest share of a template's words that stand in place; 0 without one), in place of columns
    of these names.

    Null and empty texts have no words. A row's result depends on its text and on how many rows hold each
    licence word, not on its id; repeated rows have a row each. Other columns, of any type, come through as
    they are. Empty input: no rows. Nothing is shuffled but counts by licence word; a very long text is a
    row like others, its places are looked up one by one.
    """
    require(docs, doc_id, text)
    known = [Template.of(*t) for t in templates]
    named = [(tuple(p.split(" ")), label) for p, label in phrases]
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), words_of(docs[text]).alias("words"))
    vocabulary = sorted({w for t in known for w in t.words} | {w for p, _ in named for w in p})
    counts = document_counts(rows, vocabulary)

    anchors = [(*rarest(p, counts, 1)[0], list(p), label) for p, label in named]
    postings = [(w, k, at) for k, t in enumerate(known) for w, at in rarest(t.words, counts, min(rare, (len(t.words) + 1) // 2))]
    needed = [-(-len([p for p in postings if p[1] == k]) * percent // 100) for k in range(len(known))]
    index = [(t.label, list(t.words), [w for w, n, _ in postings if n == k], [at for _, n, at in postings if n == k], list(t.mandatory), needed[k]) for k, t in enumerate(known)]
    looked_up = sorted({w for w, *_ in anchors} | {w for w, *_ in postings})

    words = F.col("words")
    word_at = lambda at: F.get(words, at)
    hits = F.filter(F.transform(words, lambda w, i: F.when(w.isin(*looked_up), F.struct(i.alias("at"), w.alias("word")))), lambda x: x.isNotNull())
    # A phrase stands where its rarest word does and all its words around that.
    phrase = _literal(anchors, "word:string, pos:int, words:array<string>, label:string")
    stands = lambda h, p: (h["at"] >= p["pos"]) & (F.slice(words, F.greatest(h["at"] - p["pos"] + 1, F.lit(1)), F.size(p["words"])) == p["words"])
    base = F.flatten(F.transform("hits", lambda h: F.transform(F.filter(phrase, lambda p: (p["word"] == h["word"]) & stands(h, p)), lambda p: F.struct((h["at"] - p["pos"]).cast("long").alias("at"), p["label"].alias("label")))))
    # A template could begin where one of its rare words says; that many numbers, each once.
    posting = _literal(postings, "word:string, template:bigint, pos:int")
    places = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.transform(F.filter(posting, lambda p: p["word"] == h["word"]), lambda p: p["template"] * PLACES + (h["at"] - p["pos"]) + (PLACES >> 1)))))
    template = _literal(index, "label:string, words:array<string>, rare:array<string>, rare_at:array<int>, mandatory:array<int>, needed:int")
    place = F.transform("places", lambda x: F.struct(F.get(template, F.floor(x / PLACES).cast("int")).alias("t"), (x % PLACES - (PLACES >> 1)).cast("int").alias("at")))
    in_place = lambda x: F.size(F.filter(F.transform(x["t"]["rare"], lambda w, i: w == word_at(x["at"] + F.get(x["t"]["rare_at"], i))), lambda same: same))
    whole = lambda x: F.forall(x["t"]["mandatory"], lambda i: F.coalesce(F.get(x["t"]["words"], i) == word_at(x["at"] + i), F.lit(False)))
    share = lambda x: F.size(F.filter(F.transform(x["t"]["words"], lambda w, i: w == word_at(x["at"] + i)), lambda same: same)) / F.size(x["t"]["words"])
    # Most texts have no hit and go no further.
    some = lambda items, value: F.when(F.size(items) > 0, value)
    found = rows.withColumn("hits", hits).withColumns({"base": some("hits", base), "places": some("hits", places)})
    found = found.withColumn("places", some("places", place)).withColumn("places", F.filter("places", lambda x: (in_place(x) >= x["t"]["needed"]) & whole(x)))
    notice = F.transform("places", lambda x: F.struct(x["t"]["label"].alias("label"), x["at"].cast("long").alias("first_word"), share(x).alias("score")))
    found = found.withColumn("notices", F.coalesce(F.array_sort(notice), _literal([], "label:string, first_word:bigint, score:double")))
    found = found.withColumn("base", F.coalesce("base", _literal([], "at:bigint, label:string")))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    new = {
        "n_words": F.size("words").cast("long"),
        "n_base": F.size("base").cast("long"),
        "first_word": F.array_min("base.at"),
        "last_word": F.array_max("base.at"),
        "base_labels": joined(F.col("base.label")),
        "labels": joined(F.concat("base.label", "notices.label")),
        "notices": F.col("notices"),
        "score": F.coalesce(F.array_max("notices.score"), F.lit(0.0)),
    }
    return found.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns if c not in new], *[v.alias(k) for k, v in new.items()])
