"""Queries of the text problems (p6 to p8) over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weirflow.llm import leak, mix, spans
from weirflow.sources.tables import table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_leaks(spark, sf_dir).select("doc_id", "item_id")


def p6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p6_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every item that p6_found looks for, and those that it leaves out as instruction or answer options."""
    return leak.left_out(table(spark, sf_dir, "eval_items"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.shares(p7_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p7_tempered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mix as large as what the listed sources hold, with the largest exponent that meets their repetition limits."""
    return mix.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), scale=1.0, one_exponent=True)


def p7_tempered_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.shares(p7_tempered(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.covered(table(spark, sf_dir, "documents"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return spans.shares(documents, spans.covered(documents))


def p8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.passages(table(spark, sf_dir, "documents"))


QUERIES = {q.__name__: q for q in (p6_found, p6_leaks, p6_left_out, p7_mix, p7_shares, p7_tempered, p7_tempered_shares, p8_found, p8_shares, p8_passages)}

# Tokens of a tokenizer, word matching with changed, added and missing words, and maximal shared
# spans over all pairs have no SQL that ends on whole tables; tests/llm hold them against brute force.
ORACLES: dict[str, str] = {}
