"""Coordinates and the relational form of contact matrices.

A bin is ``chromosome number * STRIDE + offset in bins``, so ids sort by genome
position, a bin's chromosome is a division away, and no lookup table is joined
to tell distances. ``bins`` are (bin_id, chrom, start, end); ``pixels`` are
(bin1, bin2, value), upper triangle only (bin1 <= bin2); absent pixels are zero.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STRIDE = 1_000_000
#: Bytes of input files for each part of a shuffle whose rows are kept in memory.
PART = 4 << 20


def chrom_of(b: Column | str) -> Column:
    return F.floor(_col(b) / STRIDE).cast("bigint")


def offset_of(b: Column | str) -> Column:
    return _col(b) % STRIDE


def intra(a: str = "bin1", b: str = "bin2") -> Column:
    return chrom_of(a) == chrom_of(b)


def dist(a: str = "bin1", b: str = "bin2") -> Column:
    """Bins between two bins of one chromosome."""
    return F.abs(F.col(b) - F.col(a))


def bin_of(chrom: Column | str, pos: Column | str, size: int) -> Column:
    return (_col(chrom) * STRIDE + F.floor(_col(pos) / size)).cast("bigint")


def mirror(pixels: DataFrame) -> DataFrame:
    """Both triangles: one pass that emits a pixel once on the diagonal and twice off it, without a second scan."""
    two = F.when(F.col("bin1") == F.col("bin2"), F.array(F.struct("bin1", "bin2"))).otherwise(
        F.array(F.struct("bin1", "bin2"), F.struct(F.col("bin2").alias("bin1"), F.col("bin1").alias("bin2")))
    )
    rest = [c for c in pixels.columns if c not in ("bin1", "bin2")]
    return pixels.select(F.explode(two).alias("_p"), *rest).select("_p.bin1", "_p.bin2", *rest)


def upper(pixels: DataFrame) -> DataFrame:
    """Sums both triangles into the upper one."""
    return pixels.groupBy(F.least("bin1", "bin2").alias("bin1"), F.greatest("bin1", "bin2").alias("bin2")).agg(F.sum("value").alias("value"))


def bins_per_chrom(bins: DataFrame) -> DataFrame:
    """(chrom, n): the number of bins of each chromosome."""
    return bins.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))


def rounded(value: Column | str, digits: int = 6) -> Column:
    """As C and DuckDB round a double: scaled first, halves of the scaled number away from zero; Spark's ``round`` takes halves of the printed number."""
    x = _col(value) * F.lit(10.0**digits)
    near = F.rint(x)
    return F.when(F.abs(x - near) == 0.5, x + F.signum(x) * 0.5).otherwise(near) / F.lit(10.0**digits)


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``df`` with a broadcast hint if a count of at most ``rows`` + 1 of its rows shows that it is small, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame, *keys: str, times: int = 1) -> DataFrame:
    """``df`` dealt by ``keys`` to parts in proportion to the files it is made from, ``times`` as many where its rows are as many times more.

    A task's memory then stays the same however large the input. Parts that adaptive execution joins by their
    compressed bytes do not: 64 MB of pixels are millions of rows of a hash table. Frames without files stay as they are.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    leaves = [leaves.apply(k) for k in range(leaves.size())]
    size = sum(int(x.stats().sizeInBytes()) for x in leaves if x.nodeName() == "LogicalRelation")
    if not size:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = max(-(-size // PART), min(cores, -(-size // (PART // 16))))
    return df.repartition(min(parts * times, 20_000), *keys)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def shared(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it; only where it is unset, as in tests, one in the working directory."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or f"file://{os.getcwd()}/spark-warehouse/checkpoints")
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, so an iteration's plan stays short and survives lost executors."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)
