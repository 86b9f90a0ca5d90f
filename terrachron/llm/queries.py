"""The corpus operators as registered queries, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrachron.llm.codes import vector_codes
from terrachron.llm.common import table
from terrachron.llm.decontamination import contamination
from terrachron.llm.embeddings import embedding_duplicates
from terrachron.llm.hmm import language_scores
from terrachron.llm.lines import line_report
from terrachron.llm.near_dup import near_duplicates
from terrachron.llm.packing import pack_documents
from terrachron.llm.quality import quality_scores
from terrachron.llm.secret_scan import find_secrets
from terrachron.llm.sharding import assign_shards
from terrachron.llm.spelling import spelling_groups, word_counts
from terrachron.llm.sql import ORACLE_SQL
from terrachron.llm.substrings import repeat_report
from terrachron.llm.urls import judge_urls


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of sequences of all documents. Null and empty texts are the end token alone, repeated rows are packed
    each, a null doc_id stays null; an empty table gives no rows, other columns aren't read.
    """
    return pack_documents(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document shares with the benchmark. A null text has no words, items without words or item_id have no
    windows, repeated rows get one row each; empty tables give no rows or no hits.
    """
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt to 24 shards by bytes, equal texts together. A null text has no bytes, ties go by the groups'
    hashes, repeated rows get slots of their own; an empty table gives no rows.
    """
    return assign_shards(table(spark, sf_dir, "documents"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page. A null url, or one without ://, has an empty host and path; repeated rows count and are
    judged each; an empty table gives no rows.
    """
    return judge_urls(table(spark, sf_dir, "pages"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of whole documents by shingles of four words. Null and empty texts link with nothing, rows of one
    doc_id are one document, equal sets are one component; an empty table gives no rows.
    """
    return near_duplicates(table(spark, sf_dir, "documents"), k=4)


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of whole documents. Null and empty texts stay, rows of one doc_id are one document, of equal
    passages that with the least doc_id stays; an empty table gives no rows.
    """
    return repeat_report(table(spark, sf_dir, "documents"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all vectors of a label. Null, zero and non-finite vectors and those with a null label link
    with nothing, equal vectors are linked; an empty table gives no rows.
    """
    return embedding_duplicates(table(spark, sf_dir, "embeddings"))


def op6_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all whole documents. A null or empty text is its end alone, a null doc_id isn't held out, repeated rows
    count each; an empty table gives no rows.
    """
    return language_scores(table(spark, sf_dir, "documents"))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated lines of whole documents. Null and empty texts lose nothing, rows of one doc_id are one document, of a
    group the line in the least doc_id stays; an empty table gives no rows.
    """
    return line_report(table(spark, sf_dir, "documents"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document. Null and empty texts have the statistics 0, a null doc_id isn't held out, equal texts
    get equal scores; an empty table gives no rows, labels of one class a constant.
    """
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of at least 6 letters and 5 occurrences in whole documents, with near words, forms and roots.

    Null and empty texts have no words, a null doc_id counts as an empty string in the checksum, repeated rows count each time; ties go to
    the smallest word. An empty table gives no rows; other columns aren't read.
    """
    return spelling_groups(word_counts(table(spark, sf_dir, "documents")))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all whole vectors of embeddings.

    Null vectors and those with null or non-finite components are left out, and so are those of another than the commonest length; null labels
    are one label, repeated rows are coded each for itself, ties go to the lower entry. An empty table gives no rows.
    """
    return vector_codes(table(spark, sf_dir, "embeddings"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of documents.

    Null and empty texts give a row without spans, repeated rows one each. Spans come by start and then by kind. An empty
    table gives no rows; other columns aren't read.
    """
    return find_secrets(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_minhash": op2_minhash,
    "op3_lines": op3_lines,
    "op4_embeddings": op4_embeddings,
    "op5_urls": op5_urls,
    "op6_hmm": op6_hmm,
    "op7_sharding": op7_sharding,
    "op8_packing": op8_packing,
    "op10_substrings": op10_substrings,
    "op9_decontamination": op9_decontamination,
    "op11_spelling": op11_spelling,
    "op12_codes": op12_codes,
    "op13_secrets": op13_secrets,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
