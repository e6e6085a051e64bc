"""Construction of bins and of small generated tables."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..frames import bin_of

_IUPAC = {"R": "[AG]", "Y": "[CT]", "S": "[CG]", "W": "[AT]", "K": "[GT]", "M": "[AC]", "B": "[CGT]", "D": "[AGT]", "H": "[ACT]", "V": "[ACG]", "N": "[ACGT]"}


def fixed_bins(sizes: DataFrame, size: int) -> DataFrame:
    s = sizes.select("chrom", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(size).cast("bigint"))).alias("start"))
    return s.select(bin_of("chrom", "start", size).alias("bin_id"), "chrom", "start", F.least(F.col("start") + size, "size").alias("end"))


def restriction_bins(sites: DataFrame, sizes: DataFrame, least: int = 300, most: int = 1000) -> DataFrame:
    """Sites up to ``least`` apart become one, reach out by ``most``, and share the middle of what overlaps; short bins go."""
    from .intervals import merge

    m = merge(sites.select("chrom", "start", "end"), gap=least).join(F.broadcast(sizes), "chrom")  # sizes: a row per chromosome
    wide = m.select("chrom", F.greatest(F.lit(0), F.col("start") - most).alias("s"), F.least("size", F.col("end") + most).alias("e"))
    w = W.partitionBy("chrom").orderBy("s")
    after, before = F.lead("s").over(w), F.lag("e").over(w)
    cut_ = wide.select(
        "chrom",
        F.when(before > F.col("s"), F.floor((before + F.col("s")) / 2)).otherwise(F.col("s")).cast("bigint").alias("start"),
        F.when(after < F.col("e"), F.floor((after + F.col("e")) / 2)).otherwise(F.col("e")).cast("bigint").alias("end"),
    )
    return cut_.where(F.col("end") - F.col("start") >= least)


def enlarge(bins: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Gaps closed at their middle; the first start is 0, the last end that of the chromosome if sizes are given."""
    w = W.partitionBy("chrom").orderBy("start")
    before, after = F.lag("end").over(w), F.lead("start").over(w)
    rows = bins.select("chrom", "start", "end", before.alias("_b"), after.alias("_a"))
    last = F.col("end")
    if sizes is not None:
        rows, last = rows.join(F.broadcast(sizes), "chrom"), F.col("size")
    return rows.select(
        "chrom",
        F.when(F.col("_b").isNull(), 0).otherwise(F.floor((F.col("_b") + F.col("start")) / 2)).cast("bigint").alias("start"),
        F.when(F.col("_a").isNull(), last).otherwise(F.floor((F.col("end") + F.col("_a")) / 2)).cast("bigint").alias("end"),
    )


def units(bins: DataFrame, domains: DataFrame) -> DataFrame:
    """Bins with the domain that holds them as unit, and their place in it; bins outside are units of their own."""
    from .intervals import range_join

    hit = range_join(bins, domains, 100_000).select(F.col("l.bin_id").alias("bin_id"), F.col("r.id").alias("u"), F.col("r.start").alias("d"))
    hit = hit.groupBy("bin_id").agg(F.min(F.struct("d", "u")).alias("x"))
    out = bins.join(hit, "bin_id", "left")
    return out.select("bin_id", F.coalesce(F.col("x.u").cast("string"), F.concat(F.lit("_ignore_"), F.col("bin_id"))).alias("unit"), (F.col("start") - F.coalesce("x.d", F.col("start"))).alias("unit_start"))


def windows(least: int, most: int, step: int) -> list[int]:
    """Window lengths that grow with the power 1.5."""
    out, k = [], 0
    while (w := least + int(step * k**1.5)) <= most:
        out.append(w)
        k += 1
    return out


def threshold_table(spark: SparkSession, up: int, down: int, step: int, value: float) -> DataFrame:
    return spark.range(-up, down + step, step).select(F.col("id").alias("rel_pos"), F.lit(value).alias("value"))


def _pattern(site: str) -> str:
    return "".join(_IUPAC.get(c, c) for c in site.upper())


def reverse_complement(site: str) -> str:
    return site.upper().translate(str.maketrans("ACGTRYKMBVDH", "TGCAYRMKVBHD"))[::-1]


def restriction_sites(sequences: DataFrame, sites: list[str]) -> DataFrame:
    """(chrom, start, end, strand) of sites in (chrom, seq), both strands, one row for each start; forward hits win."""
    forms = [(re.compile(_pattern(s), re.IGNORECASE), "+") for s in sites]
    forms += [(re.compile(_pattern(reverse_complement(s)), re.IGNORECASE), "-") for s in sites if reverse_complement(s) != s.upper()]

    def run(batches):
        for b in batches:
            rows = []
            for c, s in zip(b["chrom"], b["seq"], strict=True):
                at: dict[int, tuple[int, str]] = {}
                for p, strand in forms:
                    for m in p.finditer(s or ""):
                        at.setdefault(m.start(), (m.end(), strand))
                rows += [(c, k, *v) for k, v in at.items()]
            yield pd.DataFrame(rows, columns=["chrom", "start", "end", "strand"])

    return sequences.select("chrom", "seq").mapInPandas(run, f"chrom {sequences.schema['chrom'].dataType.simpleString()}, start bigint, end bigint, strand string")
