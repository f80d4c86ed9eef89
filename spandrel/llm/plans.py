"""Queries of the training-text operators, and the SQL twins of those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spandrel.llm import contributions
from spandrel.llm.handwritten import not_handwritten
from spandrel.llm.leakage import leaked_items
from spandrel.llm.parsing import failure_rates, unparsable
from spandrel.llm.sentences import split_sentences
from spandrel.llm.tokenise import encode_corpus
from spandrel.sources.tables import table


def _files(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "files", "repo", "path", "git_sha"), table(spark, d, "file_content", "git_sha", "blob")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every file named in nodes.file is named in files.path too, which alone has the texts."""
    return not_handwritten(*_files(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return unparsable(*_files(spark, d)).select("path", "git_sha").distinct()


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    return failure_rates(*_files(spark, d))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents", "doc_id", "text"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "benchmark", "item_id", "text"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return split_sentences(table(spark, d, "documents", "doc_id", "text"))


QUERIES = {"p1_found": p1_found, "p4_found": p4_found, "p4_rates": p4_rates, "p7_ids": p7_ids, "p8_found": p8_found, "p9_found": p9_found} | contributions.QUERIES
ORACLE: dict[str, str] = contributions.ORACLE
