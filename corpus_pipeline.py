"""The corpus pipeline: quality, exact dedup, near-dedup, mixing, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and
returns the next stage's documents, the last one the packed pieces. Nulls,
empty and repeated rows, and further columns are treated as the operators'
docstrings say; all columns of `docs` pass through whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from latticework.llm import exact_dedup, minhash, mixing, packing, quality, tokens
from latticework.llm.queries import graded
from latticework.llm.shared import cut


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the best grade is at least a half. Null text counts as empty; repeated
    rows are judged alike; without labels all stay; no rows give no rows."""
    return quality.keep_good(docs, graded(spark, sf_dir))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal apart from blanks: the longest, then the least id, null last. Null
    and empty texts are one group; of repeated rows one stays; no rows give no rows."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word-shingle similarity of 0.8 or more: that of least id. Documents
    without words all stay, and repeated rows of a kept one; no rows give no rows."""
    return minhash.keep_one(docs, k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in the mixed order. A null source is one, a null text has size 0;
    no rows give no rows."""
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens, placed in sequences. A null text is its end token; rows are packed as often as
    they come; no rows give no rows."""
    return packing.pack_documents(docs, tokens.public("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES = [("quality", keep_good), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mix", mix_sources), ("pack", pack)]

#: SQL can express neither the classifier nor tokenisation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
