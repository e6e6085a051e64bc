"""The registered queries of the training-data operators, one per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .sql import ORACLES


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    """The public vocabulary file; the operators take its path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import language

    return language(table(spark, sf_dir, "documents"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract

    return extract(table(spark, sf_dir, "pages"))


def op5_linedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linedup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents"))


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_digests

    return encode_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_licenses": op2_licenses,
    "op3_language": op3_language,
    "op4_html": op4_html,
    "op5_linedup": op5_linedup,
    "op6_neardup": op6_neardup,
    "op7_sharding": op7_sharding,
    "op8_bpe": op8_bpe,
    "op9_ann": op9_ann,
    "op10_packing": op10_packing,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
