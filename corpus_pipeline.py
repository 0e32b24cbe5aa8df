"""A corpus pipeline of five of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import jaccard_join, lang_id, line_dedup, mixing, queries
from weftline.llm.common import fold, materialise, table

#: Documents whose language holds less of their letters are rejected, as are those without one.
MIN_LANGUAGE_SHARE = 0.5
#: Near copies of the stage; op10's query has its own shingles and share.
NEAR_SHINGLE, NEAR_PERCENT = 5, 80


# All stages: rows with null or repeated ids are documents like others, columns of any name come through
# as they are, an empty table gives an empty one.


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; what lang says of a document is not asked. Null texts, empty ones and
    those without a letter have none and go; repeated rows go or stay together."""
    model = lang_id.fit(docs.where(fold(docs["doc_id"]) != 0))
    found = lang_id.labelled(docs, model)
    return found.where((F.col("lang_pred") != lang_id.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SHARE)).select("doc.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur before, n_chars with their new lengths; documents of which
    nothing is left go, null and empty texts stay. The smallest id keeps a passage (null is last)."""
    return line_dedup.drop_repeated_lines(docs, n_chars="n_chars")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id: four fifths of the five-word
    shingles of two are common. Texts without words, null ones too, are no copies and stay."""
    return jaccard_join.drop_near_copies(docs, size=NEAR_SHINGLE, percent=NEAR_PERCENT)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in proportion to their weights; a document may come twice or not at all. Null is a source
    like others, null texts count no words."""
    return mixing.mix_sources(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences; a null or empty text is its end token alone."""
    return queries.packed(docs)


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_copies", near_copies),
    ("mixture", mixture),
    ("pack", pack),
]

#: Language identification, classes by shingles and tokens are beyond SQL: tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
