"""From raw documents to packed training sequences: four stages, each an operator of listloom.llm.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. Its result is
written as Parquet to the shared folder and read again as the next stage's ``docs``, so a lost
executor repeats one stage at most. The first three return the columns of ``documents`` as they
came; the last returns the packed pieces. Rows with a null text or id pass every filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from listloom.llm import decontaminate, neardup, packing, toxicity
from listloom.llm.queries import CATEGORIES, tokenizer_file
from listloom.llm.tables import read
from listloom.session import cut

#: The similarity from which documents count as near-duplicates here; op6's own 85 binds only its query.
NEAR_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the toxicity chain rejects go."""
    return toxicity.remove_toxic(docs, read(spark, sf_dir, "labels"), CATEGORIES)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five words, a similarity of 0.8 or more."""
    return neardup.keep_one(docs, percent=NEAR_PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.remove_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences, with their token ids."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: No stage but decontamination can be expressed in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
