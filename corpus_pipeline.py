"""Documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrachron.llm.common import materialise, short_batches, table
from terrachron.llm.decontamination import decontaminate
from terrachron.llm.lines import without_repeated_lines
from terrachron.llm.near_dup import drop_near_duplicates
from terrachron.llm.packing import pack_documents
from terrachron.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go. Null and empty texts are judged by the statistics 0, equal texts alike; an empty table stays empty."""
    short_batches(spark)
    return keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines are cut out; a document with nothing left goes. Null and empty texts stay, of equal lines that of the least doc_id; an empty table stays empty."""
    short_batches(spark)
    return without_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (five-word shingles, similarity 0.8 or more) the least doc_id stays. Null and empty texts stay; an empty table stays empty."""
    short_batches(spark)
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark items go. Null and empty texts stay, and all where there are no items; an empty table stays empty."""
    short_batches(spark)
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens. Null and empty texts are the end token alone; an empty table gives no pieces."""
    short_batches(spark)
    return pack_documents(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: No SQL: a fitted model, a fuzzy join and tokenizers are not expressible. The stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
