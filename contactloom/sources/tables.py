"""The driver's tables as genome data: mates, read pairs, bins, intervals and reference points.

Five chromosomes 1 to 5; a part is a locus, 1 kb apart from the next of its
chromosome; a line item is a mapped read; the items of an order are the reads of
one fragment, so each two of them are a pair. Even orders are sample 0, odd ones 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..frames import bin_of, rounded, spread

BIN = 10_000
READ_LENGTH = 36


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus"
    )
    li = spread(li, "l_orderkey")
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return li.select(
        "l_orderkey",
        F.row_number().over(order).alias("m"),
        (1 + F.col("l_partkey") % 5).alias("chrom"),
        (F.floor(F.col("l_partkey") / 5) * 1000).cast("bigint").alias("pos"),
        F.col("l_quantity").cast("int").alias("mapq"),
        (F.col("l_linestatus") == "O").alias("rev"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45), 4).otherwise(0).alias("flag"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of an order's mates; both sides share the partitioning by order, so the join adds no shuffle to the window's."""
    m = mates(spark, sf_dir)
    side = lambda k: m.select("l_orderkey", *[F.col(c).alias(f"{c}{k}") for c in ("m", "chrom", "pos", "mapq", "rev", "flag")])
    both = side(1).join(side(2), "l_orderkey").where("m1 < m2")
    return both.select(
        (F.col("l_orderkey") * 10_000 + F.col("m1") * 100 + F.col("m2")).alias("read_id"),
        (F.col("l_orderkey") % 2).alias("sample"),
        *[f"{c}{k}" for k in (1, 2) for c in ("chrom", "pos", "mapq", "rev", "flag")],
        F.lit(READ_LENGTH).alias("len1"),
        F.lit(READ_LENGTH).alias("len2"),
    )


def chrom_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.groupBy((1 + F.col("p_partkey") % 5).alias("chrom")).agg((F.max(F.floor(F.col("p_partkey") / 5)) * 1000 + 1000).cast("bigint").alias("size"))


def fixed_bins(spark: SparkSession, sf_dir: str, size: int = BIN) -> DataFrame:
    from ..operators.bins import fixed_bins as build

    return build(chrom_sizes(spark, sf_dir), size)


def pixels(spark: SparkSession, sf_dir: str, size: int = BIN, sample: int | None = None) -> DataFrame:
    """Upper-triangle counts of all pairs, without filters: (bin1, bin2, value)."""
    p = pairs(spark, sf_dir)
    if sample is not None:
        p = p.where(F.col("sample") == sample)
    a, b = bin_of("chrom1", F.col("pos1") + READ_LENGTH // 2, size), bin_of("chrom2", F.col("pos2") + READ_LENGTH // 2, size)
    cells = spread(p.select(F.least(a, b).alias("bin1"), F.greatest(a, b).alias("bin2")), "bin1", "bin2")
    return cells.groupBy("bin1", "bin2").agg(F.count(F.lit(1)).cast("double").alias("value"))


def intervals(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    """(chrom, start, end, id, score) of events."""
    e = table(spark, sf_dir, "events")
    if kind:
        e = e.where(F.col("event_type") == kind)
    start = (F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01 00:00:00"))).cast("bigint")
    return e.select(F.col("event_type").alias("chrom"), start.alias("start"), (start + 60 + 10 * (F.col("event_id") % 50)).alias("end"), F.col("event_id").alias("id"), F.col("value").alias("score"))


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive domains of 3 to 7 bins that tile each chromosome: (chrom, start, end, id)."""
    b = fixed_bins(spark, sf_dir)
    edge = b.where((F.col("start") / BIN) % 5 == F.col("chrom") % 3).select("chrom", "start")
    w = W.partitionBy("chrom").orderBy("start")
    return edge.withColumn("end", F.lead("start").over(w)).where("end IS NOT NULL").select("chrom", "start", "end", (F.col("chrom") * 1000 + F.row_number().over(w)).alias("id"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference points (chrom, start, end, gene, id): parts of size 1."""
    p = table(spark, sf_dir, "part").where("p_size = 1")
    at = (F.floor(F.col("p_partkey") / 5) * 1000).cast("bigint")
    return p.select((1 + F.col("p_partkey") % 5).alias("chrom"), at.alias("start"), (at + 1000).alias("end"), F.col("p_name").alias("gene"), F.col("p_partkey").alias("id"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value per bin: (bin_id, value), the mean price of the parts in it, centred on the mean of its chromosome."""
    p = table(spark, sf_dir, "part").select(bin_of(1 + F.col("p_partkey") % 5, F.floor(F.col("p_partkey") / 5) * 1000, BIN).alias("bin_id"), "p_retailprice")
    v = p.groupBy("bin_id").agg(F.avg("p_retailprice").alias("v"))
    return v.select("bin_id", rounded(F.col("v") - F.avg("v").over(W.partitionBy(F.floor(F.col("bin_id") / 1_000_000))), 6).alias("value"))
