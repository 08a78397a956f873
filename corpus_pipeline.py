"""A corpus in five stages: toxic texts, texts of no clear language, near-duplicates and benchmark
passages go; what is left is encoded. Each stage takes (spark, docs, sf_dir) and works on all that the
one before kept; models that need labels or languages learn from the stage's own input.

Defined results: stages judge rows, not ids, so rows of one id or of a null id are rows of their own, and
null, empty and very long texts are judged whole as the operators' docstrings say; rows keep all their columns,
whatever their names; equal rows stay or go together, but near_duplicates keeps one row of each class; an empty
table gives empty ones. Without labelled rows of both classes nothing is toxic; without a learned language, and of
texts without a letter, nothing is kept by `language`, as no main language is known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.llm import bpe, contamination, langid, neardup, toxicity
from lumenspan.llm.common import materialise, table

#: A document stays if its main language has at least this share.
MAIN_LANGUAGE = 0.4


def _whole(docs: DataFrame) -> DataFrame:
    """(text, _row): each row as one value beside its text, so that no column of it clashes."""
    return docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text isn't predicted toxic; a null or empty text is judged as a text without words."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.score(_whole(docs), model).where("predicted = 0").select("_row.*")


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose main language has a share of MAIN_LANGUAGE; texts that are null or without a letter have none."""
    model = langid.fit(docs, F.lit(True))
    judged = langid.predict(_whole(docs), model)
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= MAIN_LANGUAGE)).select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates: the first by doc_id and hash of the text; rows of a null id or text stay."""
    return neardup.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text holds no text of `benchmark`, whatever the ids."""
    return contamination.drop_rows(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows and columns with the ids of the text and their number, and digests of the ids and of the bytes they decode to."""
    return bpe.digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: Trained models and sampled signatures can't be written in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
