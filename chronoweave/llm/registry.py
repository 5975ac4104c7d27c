"""Queries p8 to p10; none of them can be told in SQL over whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm import abuse, mixing, packing
from chronoweave.llm.measure import TOKENIZER
from chronoweave.sources.tables import table


def _tokenizer(spark: SparkSession) -> str:
    """Path of the vocabulary: a setting of the session, by default that of the public vocabularies."""
    return spark.conf.get("spark.chronoweave.tokenizer", TOKENIZER)


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), table(spark, folder, "pack_sizes"), _tokenizer(spark))


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Space used and locality per capacity."""
    sizes = table(spark, folder, "pack_sizes")
    return packing.fill_report(packing.pack(table(spark, folder, "documents"), sizes, _tokenizer(spark), positions=True), sizes)


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), _tokenizer(spark))[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share per source."""
    return mixing.shares(*mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), _tokenizer(spark)))


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return abuse.score_documents(documents, abuse.fit(documents, table(spark, folder, "review_labels")))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.abusive(_scored(spark, folder))


def p10_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's score."""
    return _scored(spark, folder).select("doc_id", F.round("score", 6).alias("score"))


def p10_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Rate of abusive documents per source."""
    return abuse.source_rates(_scored(spark, folder))


QUERIES = {f.__name__: f for f in (p8_containers, p8_fill, p9_mixture, p9_shares, p10_found, p10_scores, p10_rates)}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return {}
