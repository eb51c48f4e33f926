"""The corpus pipeline: documents to packed sequences, stage by stage.

Each stage takes the session, the documents that its predecessor kept and the data folder, and returns a table that
is written as Parquet and read again by the next stage. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelweave.llm import decontaminate, near_text, packing, personal_data, quality
from panelweave.llm.common import table
from panelweave.llm.queries import GOOD, quality_model, word_bpe
from panelweave.session import scratch_path


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject, with all their columns.

    Null and empty texts are scored like others; repeated rows share their fate; an empty table stays empty.
    """
    return quality.keep_good(docs, quality_model(spark, docs, sf_dir), GOOD)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of every group of near duplicates by shingles of five words.

    Texts without words and rows with a null id stay; of rows of one id one stays; an empty table stays empty.
    """
    return near_text.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate; those without words stay, repeated rows share their fate."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind."""
    return personal_data.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of all documents, packed into sequences; a null or empty text is its end id, repeated rows are packed each."""
    return packing.pack_documents(docs, word_bpe())


STAGES = [("quality", good), ("near duplicates", distinct), ("contamination", clean), ("personal data", private), ("packing", packed)]
#: A fitted classifier and a tokenizer are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; each stage's table is kept in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
