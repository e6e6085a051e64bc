"""Read-pair filters, classes, counters and the contact matrix.

Every pair gets its class in one projection of ordered CASE branches; matrix and
counters are two aggregations with map-side combine, so no hot locus meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import bin_of
from .intervals import range_join

MIN_MAPQ, LIBRARY, SELF_CIRCLE, SHORT = 15, 1000, 25_000, 20_000
KEY = ("k1", "k2", "s1", "s2")


def primary(alignments: DataFrame) -> DataFrame:
    return alignments.where(F.col("flag").bitwiseAND(256) == 0)


def aligned_start(cigar: Column) -> Column:
    """Bases before the first match of a CIGAR string; the record with the least is the right one of a split read."""
    before = F.regexp_extract(cigar, r"^((?:\d+[^\dM])*)", 1)
    return F.aggregate(F.regexp_extract_all(before, F.lit(r"(\d+)"), F.lit(1)), F.lit(0), lambda a, x: a + x.cast("int"))


def pick_supplementary(alignments: DataFrame) -> DataFrame:
    """One record per read, that which starts to match first; reverse reads are scanned from their end."""
    ends = F.array_join(F.reverse(F.regexp_extract_all("cigar", F.lit(r"(\d+[A-Z=])"), F.lit(1))), "")
    start = aligned_start(F.when(F.col("flag").bitwiseAND(16) != 0, ends).otherwise(F.col("cigar")))
    # a column each, so that those nobody asks for are not shuffled
    keyed = alignments.withColumn("_at", F.struct(start.alias("start"), "chrom", "pos"))
    return keyed.groupBy("read_id").agg(*[F.min_by(c, "_at").alias(c) for c in alignments.columns if c != "read_id"]).select(*alignments.columns)


def quality_class(min_mapq: int = MIN_MAPQ) -> Column:
    """NULL for a pair that passes; 'not unique' asks the first mate alone, as the reference does."""
    return (
        F.when((F.col("flag1").bitwiseAND(4) != 0) | (F.col("flag2").bitwiseAND(4) != 0), "one mate unmapped")
        .when(((F.col("mapq1") < min_mapq) | (F.col("mapq2") < min_mapq)) & (F.col("mapq1") == 0), "one mate not unique")
        .when((F.col("mapq1") < min_mapq) | (F.col("mapq2") < min_mapq), "one mate low quality")
    )


def with_key(pairs: DataFrame) -> DataFrame:
    """The duplicate key: chromosomes and starts sorted apart from one another."""
    return pairs.select(
        "*", F.least("chrom1", "chrom2").alias("k1"), F.greatest("chrom1", "chrom2").alias("k2"), F.least("pos1", "pos2").alias("s1"), F.greatest("pos1", "pos2").alias("s2")
    )


def deduplicate(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The first pair of each key: a minimum of structs, combined before the shuffle, instead of a window over a hot key."""
    rows = with_key(pairs)
    first = rows.groupBy(*by, *KEY).agg(F.min(F.struct("read_id", *[c for c in pairs.columns if c not in ("read_id", *by)])).alias("p"))
    return first.select(*by, "p.*")


def orientation() -> Column:
    left, right = F.when(F.col("pos1") <= F.col("pos2"), F.col("rev1")).otherwise(F.col("rev2")), F.when(F.col("pos1") <= F.col("pos2"), F.col("rev2")).otherwise(F.col("rev1"))
    return (
        F.when(F.col("chrom1") != F.col("chrom2"), "different chromosome")
        .when(~left & right, "inward")
        .when(left & ~right, "outward")
        .when(left & right, "same-strand-left")
        .otherwise("same-strand-right")
    )


def length_class(short: int = SHORT) -> Column:
    return F.when(F.col("chrom1") != F.col("chrom2"), "inter").when(F.abs(F.col("pos1") - F.col("pos2")) < short, "short").otherwise("long")


def dangling(seq: Column, rev: Column, end: str) -> Column:
    """Forward reads that start with the sequence a cut leaves, reverse ones that end with its complement."""
    other = end.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    s = F.upper(seq)
    return F.when(rev, s.endswith(end) | s.endswith(other)).otherwise(s.startswith(end) | s.startswith(other))


def fragment_class(pairs: DataFrame, sites: DataFrame | None, library: int = LIBRARY, keep_self_ligation: bool = False) -> DataFrame:
    """Adds ``fragment``: 'same fragment' or 'self ligation' for short inward pairs, by whether a cut site lies between; else NULL."""
    lo, hi = F.least("pos1", "pos2"), F.greatest("pos1", "pos2")
    near = (orientation() == "inward") & (hi - lo < library)
    if sites is None:
        return pairs.withColumn("fragment", F.when(near, "same fragment"))
    spans = pairs.where(near).select("read_id", F.col("chrom1").alias("chrom"), lo.alias("start"), (hi + 1).alias("end"))
    hit = range_join(spans, sites.select("chrom", "start", "end"), bucket=max(library, 1000)).select(F.col("l.read_id").alias("read_id")).distinct()
    joined = pairs.join(hit.withColumn("_cut", F.lit(True)), "read_id", "left")
    ligated = F.lit(None) if keep_self_ligation else F.lit("self ligation")
    return joined.withColumn("fragment", F.when(near & F.col("_cut"), ligated).when(near, "same fragment")).drop("_cut")


def self_circle(distance: int = SELF_CIRCLE) -> Column:
    """Counted, never dropped."""
    return (orientation() == "outward") & (F.abs(F.col("pos1") - F.col("pos2")) < distance)


def contact_matrix(pairs: DataFrame, size: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(bin1, bin2, value) of accepted pairs, upper triangle, at the middle of the reads."""
    a, b = (bin_of(f"chrom{k}", F.col(f"pos{k}") + F.floor(F.col(f"len{k}") / 2), size) for k in (1, 2))
    return pairs.groupBy(*by, F.least(a, b).alias("bin1"), F.greatest(a, b).alias("bin2")).agg(F.count(F.lit(1)).cast("double").alias("value"))


def accepted(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return deduplicate(pairs.where(quality_class().isNull()), by)


def qc(pairs: DataFrame) -> DataFrame:
    """One row: sequenced, rejected by class, usable, duplicates, accepted, and shares of the three denominators."""
    q = quality_class()
    usable = pairs.where(q.isNull())
    kept = deduplicate(usable)
    one = pairs.agg(
        F.count(F.lit(1)).alias("sequenced"),
        *[F.count_if(q == k).alias(n) for k, n in (("one mate unmapped", "unmapped"), ("one mate not unique", "not_unique"), ("one mate low quality", "low_quality"))],
    )
    two = kept.agg(
        F.count(F.lit(1)).alias("accepted"),
        F.count_if(self_circle()).alias("self_circles"),
        *[F.count_if(orientation() == o).alias(o.replace("-", "_").replace(" ", "_")) for o in ("inward", "outward", "same-strand-left", "same-strand-right", "different chromosome")],
        *[F.count_if(length_class() == o).alias(o + "_range") for o in ("short", "long")],
    )
    out = one.crossJoin(two)  # one row each
    usable_n = F.col("sequenced") - F.col("unmapped") - F.col("not_unique") - F.col("low_quality")
    return out.withColumn("usable", usable_n).withColumn("duplicates", F.col("usable") - F.col("accepted")).withColumn("accepted_share", F.round(F.col("accepted") / F.col("sequenced"), 6))


def coverage(pairs: DataFrame, size: int, step: int = 10) -> DataFrame:
    """(bin_id, extra): the largest count of reads on one sub-bin of ``step`` bases."""
    reads = pairs.select(F.explode(F.array(*[F.struct(F.col(f"chrom{k}").alias("c"), F.col(f"pos{k}").alias("p"), F.col(f"len{k}").alias("n")) for k in (1, 2)])).alias("r")).select("r.*")
    hits = reads.groupBy("c", "p", "n").agg(F.count(F.lit(1)).alias("w"))  # equal reads become one before they are spread
    subs = hits.select("c", F.explode(F.sequence(F.floor(F.col("p") / step), F.floor((F.col("p") + F.col("n") - 1) / step))).alias("s"), "w")
    per = subs.groupBy("c", "s").agg(F.sum("w").alias("w"))
    return per.groupBy(bin_of("c", F.col("s") * step, size).alias("bin_id")).agg(F.max("w").alias("extra"))


def reflagged(pairs: DataFrame) -> DataFrame:
    """Pairs with SAM flags set anew: paired (1), reverse (16), first (64) and second (128) mate."""
    flag = lambda k, mate: (F.when(F.col(f"rev{k}"), 16).otherwise(0) + 1 + mate).cast("bigint")
    return pairs.withColumns({"flag1": flag(1, 64), "flag2": flag(2, 128)})


def test_run(pairs: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """The first rows alone, for a quick look at the counters."""
    return pairs.limit(rows)


def qc_fractions(counters: DataFrame) -> DataFrame:
    """(part, key, n, fraction) of a counter row: mapping and distance of all, orientation of pairs within chromosomes."""
    of = {
        "mapping": (("accepted", "low_quality", "not_unique", "unmapped"), F.col("sequenced")),
        "discarded": (("duplicates",), F.col("usable")),
        "distance": (("different_chromosome", "short_range", "long_range"), F.col("accepted")),
        "orientation": (("inward", "outward", "same_strand_left", "same_strand_right"), F.col("inward") + F.col("outward") + F.col("same_strand_left") + F.col("same_strand_right")),
    }
    rows = [F.struct(F.lit(part).alias("part"), F.lit(k).alias("key"), F.col(k).alias("n"), F.when(low > 0, F.col(k) / low).alias("fraction")) for part, (keys, low) in of.items() for k in keys]
    return counters.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def without_dangling(pairs: DataFrame, end: str, library: int = LIBRARY) -> DataFrame:
    """Pairs without the near inward ones of which a mate begins or ends in the sequence a cut leaves; needs seq1 and seq2."""
    near = (orientation() == "inward") & (F.abs(F.col("pos1") - F.col("pos2")) < library)
    return pairs.where(~(near & (dangling(F.col("seq1"), F.col("rev1"), end) | dangling(F.col("seq2"), F.col("rev2"), end))))
