"""A pipeline for training text: from ``documents`` to token ids.

STAGES lists (name, function) in order. A function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's documents; all but the last return the columns of their documents. Null and empty texts have no language and go in
the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trapline.llm import bpe, decontamination, exact_dedup, language_id, near_dedup
from trapline.llm.queries import VOCABULARY
from trapline.llm.shared import read, stored


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that are learnt from the documents' own ``lang``. Those without a letter go, and those whose code
    is longer than ``language_id.MOST_BITS`` bits a byte, which no language's tree foresees. Where ``lang`` is null in all rows nothing can
    be learnt, and only texts without a letter go."""
    return language_id.drop_undetermined(docs, language_id.train(docs))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id."""
    return exact_dedup.drop_copies(docs)


def keep_one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, five words a shingle and a similarity of 0.8 or more, the one with the smallest id."""
    return near_dedup.drop_near_duplicates(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any ``benchmark`` item."""
    return decontamination.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): token ids of each text, and the text they give back."""
    return bpe.encode(docs, VOCABULARY, decoded=True)


STAGES = [
    ("language_id", keep_known_languages),
    ("exact_dedup", keep_one_copy),
    ("near_dedup", keep_one_near_copy),
    ("decontamination", keep_clean),
    ("bpe", tokens),
]

#: Language identification learns its model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is a table in the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
