"""From raw documents to a training mix: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and reread as the next one's docs.  All but the last return the
columns of documents.

The near-dedup stage drops what the SimHash operator links (pivot tables, three
bits), and what is similar by the measure of five words and 0.8: documents meet in
SimHash and MinHash cells, and shingle sets decide there (see `similar.py`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeaudit.llm.common import table
from codeaudit.llm.decontaminate import drop_contaminated_rows
from codeaudit.llm.exact_dedup import drop_copies
from codeaudit.llm.langid import keep_identified
from codeaudit.llm.mixing import mixed_documents
from codeaudit.llm.similar import drop_similar
from codeaudit.session import shared_folder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_similar(docs, by_bits=True)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated_rows(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


STAGES = [("language ID", language), ("exact dedup", exact_dedup), ("near-dedup", near_dedup),
          ("benchmark decontamination", decontaminate), ("mixing", mix)]

# The random draws of the last stage and the minima of the third are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each but the last returns is written below the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            folder = shared_folder(spark, f"pipeline-stage-{k}")
            docs.write.parquet(folder)
            docs = spark.read.parquet(folder)
    return docs
