"""The corpus pipeline: rules, classifier, near-duplicates, mixing, tokens.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir), where
``docs`` is what the stage before kept, and returns the rows that go on, with
the columns of ``documents`` (the last one: with token ids).  Every stage takes
nulls in any column, empty and very long texts, repeated rows, other columns that
pass along, and an empty table, which gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fathom.llm import bpe, importance, mixing, quality_rules, simhash
from fathom.llm.common import new_folder, table
from fathom.llm.queries import VOCABULARY


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the compression bands.  Null and empty
    texts go; repeated rows all stay or all go."""
    return quality_rules.keep(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards the labelled good ones takes.  Equal
    rows are taken alike; without labels of good documents among them all are."""
    return importance.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group of near-duplicates:
    texts whose shingles of five words have a similarity of 0.8 or more.  Of equal rows
    one stays; rows without an id stay only where their group has no others; null and
    empty texts are one group."""
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix to the target weights takes it: not at all, or
    up to three times.  A null source is a source; documents without words go."""
    return mixing.emit(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and the token ids of the text, none for a null or empty one."""
    encoded = bpe.encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return encoded.select("doc_id", "source", "ids")


STAGES = [
    ("quality_rules", quality),
    ("quality_classifier", classifier),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("tokens", tokens),
]

#: Compression ratios, hashed models and XXH64 have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each but the last keeps is written to the
    shared folder and read again, so that no stage is computed twice."""
    docs = table(spark, sf_dir, "documents")
    *stages, (_, last) = STAGES
    for name, stage in stages:
        folder = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return last(spark, docs, sf_dir)
