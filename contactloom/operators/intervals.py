"""Interval operators on (chrom, start, end), half-open, by bucketed range joins and running windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _dealt(df: DataFrame, name: str, bucket: int) -> DataFrame:
    at = F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("end") - 1) / bucket)))
    return df.where("end > start").select(F.col("chrom").alias("_c"), at.alias("_k"), F.struct(*df.columns).alias(name))


def range_join(left: DataFrame, right: DataFrame, bucket: int = 10_000, slack: int = 0) -> DataFrame:
    """Overlapping pairs as structs ``l`` and ``r``.

    Both sides are dealt to all buckets they touch, so an equi join finds the
    overlaps; a pair that meets in several counts in the one where both have begun.
    ``slack`` widens the left side.
    """
    wide = left.withColumns({"_s": F.col("start") - slack, "_e": F.col("end") + slack}) if slack else left
    l_ = _dealt(wide.withColumns({"start": F.col("_s"), "end": F.col("_e")}).drop("_s", "_e") if slack else left, "l", bucket)
    both = l_.join(_dealt(right, "r", bucket), ["_c", "_k"])
    ok = (F.col("l.start") < F.col("r.end")) & (F.col("r.start") < F.col("l.end")) & (F.col("_k") == F.floor(F.greatest("l.start", "r.start") / bucket))
    out = both.where(ok).select("l", "r")
    if slack:
        out = out.withColumn("l", F.col("l").withField("start", F.col("l.start") + slack).withField("end", F.col("l.end") - slack))
    return out


def overlap_count(left: DataFrame, right: DataFrame, bucket: int = 10_000, slack: int = 0) -> DataFrame:
    """``left`` with ``n``, the number of overlapping rows of ``right``."""
    pairs = range_join(left, right, bucket, slack).groupBy(F.col("l").alias("_l")).agg(F.count(F.lit(1)).alias("n"))
    hits = pairs.select("_l.*", "n")
    rows = left.groupBy(*left.columns).agg(F.count(F.lit(1)).alias("_m"))
    out = rows.join(hits, left.columns, "left").select(*left.columns, F.coalesce("n", F.lit(0)).alias("_n"), "_m")
    return out.select(*left.columns, (F.col("_n") / F.col("_m")).cast("bigint").alias("n"), F.explode(F.sequence(F.lit(1), F.col("_m"))).alias("_x")).drop("_x")


def semi(left: DataFrame, right: DataFrame, bucket: int = 10_000, slack: int = 0) -> DataFrame:
    """The distinct rows of ``left`` that overlap a row of ``right``."""
    return range_join(left, right, bucket, slack).select("l.*").distinct()


def merge(df: DataFrame, gap: int = 0, extra: dict[str, Column] | None = None) -> DataFrame:
    """Unions of intervals at most ``gap`` apart: (chrom, start, end, n), and further aggregates."""
    w = W.partitionBy("chrom").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(reach.isNull() | (F.col("start") > reach + gap), 1).otherwise(0))
    isle = marked.withColumn("_i", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    more = [c.alias(k) for k, c in (extra or {}).items()]
    return isle.groupBy("chrom", "_i").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"), *more).drop("_i")


def first_target(left: DataFrame, targets: DataFrame, bucket: int = 10_000) -> DataFrame:
    """Rows of ``left`` with the first of the targets they overlap."""
    return range_join(left, targets, bucket).groupBy("l").agg(F.min(F.struct("r.start", "r.end")).alias("t")).select("l.*", F.col("t.start").alias("t_start"), F.col("t.end").alias("t_end"))


def snap(df: DataFrame, size: int) -> DataFrame:
    """Starts and ends moved out to bin borders, distinct."""
    return df.select("chrom", (F.floor(F.col("start") / size) * size).alias("start"), ((F.floor(F.col("end") / size) + 1) * size).alias("end")).distinct()
