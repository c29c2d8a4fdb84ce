"""A corpus pipeline: quality, exact copies, near copies, benchmark passages, source mix.

Each stage reads what the one before it kept, calls one operator of ``strata.llm`` and writes its rows as Parquet in
the folder that the cluster shares.  A stage that fails or loses an executor is run again from its input's files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strata.llm.common import cut, scratch, table
from strata.llm.decontaminate import keep_clean
from strata.llm.exact_dedup import keep_first_copies
from strata.llm.mixing import mix_documents
from strata.llm.near import keep_one_of_near
from strata.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that the classifier rejects go; without labels none does."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: one row of each group of equal texts stays, the smallest identifier; null equals the empty text."""
    return keep_first_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: one document of each group of near copies (five-word shingles, similarity 0.8) stays."""
    return keep_one_of_near(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: contaminated documents go; an empty benchmark leaves all."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that the mix takes, with ``copies``; sizes without words are never taken."""
    return mix_documents(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("benchmark", benchmark), ("mix", mix)]
#: Three stages (a trained network, components of near copies, mixing by hashes) can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that all stages keep, with ``copies``: how often the mix takes each."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark) as keep:  # what a stage cut on its way goes once its rows are written
            docs = cut(stage(spark, docs, sf_dir), name)
            keep.append(docs)
    return docs
