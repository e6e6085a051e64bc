"""Steps that follow one another: domain calls, piled-up regions, capture interactions and what is reported of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..frames import STRIDE, bins_per_chrom, chrom_of, cut, dist, intra, mirror, offset_of, small
from . import features as X
from .intervals import merge, range_join


# -- domains -----------------------------------------------------------------------------
def default_depths(size: int) -> tuple[int, int, int]:
    """Least and largest window and step in bases for a bin size."""
    low, high, step = (30, 60, 4) if size < 1000 else (10, 40, 2) if size < 20_000 else (5, 10, 2)
    return low * size, high * size, step * size


def boundary_tests(pixels: DataFrame, candidates: DataFrame, bins: DataFrame, width: int) -> DataFrame:
    """(bin_id, z, p): the better of two rank sums, of the rectangle at a cut against those ``width`` bins before and behind it.

    Absent cells count as zero; a cut without cells on any of the three has no test.
    """
    n = F.broadcast(bins_per_chrom(bins))
    c = candidates.select("bin_id").distinct().withColumn("chrom", chrom_of("bin_id")).join(n, "chrom")
    at = lambda o: F.greatest(F.lit(0), F.least(F.col("n") - 1, offset_of("bin_id") + o))
    places = F.explode(F.array(*[F.struct(F.lit(s).alias("s"), at(s * width).alias("o")) for s in (-1, 0, 1)]))
    c = c.select("bin_id", "chrom", "n", places.alias("q")).select("bin_id", "chrom", "n", "q.s", "q.o").where("o > 0")
    left = F.sequence(F.greatest(F.lit(0), F.col("o") - width), F.col("o") - 1)
    right = F.sequence(F.col("o"), F.least(F.col("n") - 1, F.col("o") + width - 1))
    cells = c.withColumn("i", F.explode(left)).withColumn("j", F.explode(right))
    cells = cells.select("bin_id", "s", (F.col("chrom") * STRIDE + F.col("i")).alias("bin1"), (F.col("chrom") * STRIDE + F.col("j")).alias("bin2"))
    v = cells.join(pixels, ["bin1", "bin2"], "left").select("bin_id", "s", F.coalesce("value", F.lit(0.0)).alias("value"))
    # the cells of the cut stand against both others
    against = F.when(F.col("s") == 0, F.array(F.lit(-1), F.lit(1))).otherwise(F.array("s"))
    t = X.rank_sum(v.select("bin_id", F.explode(against).alias("against"), "value", F.when(F.col("s") == 0, 1).otherwise(2).alias("side")), ["bin_id", "against"])
    best = t.groupBy("bin_id").agg(F.count(F.lit(1)).alias("k"), F.max(F.struct(F.abs("z").alias("z"), "p")).alias("b"))
    return candidates.select("bin_id").distinct().join(best.where("k = 2").select("bin_id", "b.z", "b.p"), "bin_id", "left")


def corrected(df: DataFrame, how: str = "fdr", q: float = 0.01, p: str = "p") -> DataFrame:
    """Adds ``significant`` by false discovery rate, Bonferroni ('bonferroni', which also multiplies p, 1 at most) or no correction ('none'); NULL counts as 1."""
    if how == "fdr":
        return X.benjamini_hochberg(df.withColumn("_p", F.coalesce(p, F.lit(1.0))), "_p", q).drop("_p")
    if how == "bonferroni":
        n = df.agg(F.count(F.lit(1)).alias("_n"))
        df = df.crossJoin(F.broadcast(n)).withColumn(p, F.least(F.lit(1.0), F.col(p) * F.col("_n"))).drop("_n")
    return df.withColumn("significant", F.coalesce(F.col(p) <= q, F.lit(False)))


def called_boundaries(pixels: DataFrame, bins: DataFrame, widths: list[int], delta: float = 0.01, how: str = "fdr", q: float = 0.01, look: int = 4) -> DataFrame:
    """(bin_id, score, delta, p): valleys of the mean score that are deep enough and whose test holds."""
    score = X.mean_score(X.diamonds(pixels, bins, widths))
    deep = X.deltas(score).select("bin_id", "delta")
    low = X.valleys(score, look).where("kind = 'valley'").select("bin_id", "score").join(deep, "bin_id")
    tested = corrected(low.join(boundary_tests(pixels, low, bins, min(widths)), "bin_id"), how, q)
    return tested.where((F.col("delta") >= delta) & F.col("significant") & F.col("p").isNotNull()).select("bin_id", "score", "delta", "p")


def boundary_ranges(boundaries: DataFrame, bins: DataFrame) -> DataFrame:
    """Adds start and end, the middles of the bins before and behind each boundary."""
    middle = F.col("start") + F.floor((F.col("end") - F.col("start")) / 2)
    m = small(bins.select("bin_id", "chrom", middle.cast("bigint").alias("m")))
    before = m.select((F.col("bin_id") + 1).alias("bin_id"), F.col("m").alias("start"))
    return boundaries.join(m.withColumnRenamed("m", "end"), "bin_id").join(before, "bin_id")


def called_domains(boundaries: DataFrame, bins: DataFrame) -> DataFrame:
    b = boundaries.join(small(bins.select("bin_id", "chrom", F.col("start").alias("pos"))), "bin_id")
    return X.domains_of(b.select("chrom", "pos", "score"))


def supported(domains: DataFrame, peaks: DataFrame, size: int, least: int = 1, within: float = 0.2) -> DataFrame:
    """Domains without those whose left border has no bin with enough peaks and whose score is within ``within`` of both neighbours'."""
    binned = X.peaks_per_bin(peaks, size, least).select("chrom", "start").distinct().withColumn("hit", F.lit(True))
    w = W.partitionBy("chrom").orderBy("start", "end")
    x = domains.withColumns({"_a": F.lag("score").over(w), "_b": F.lead("score").over(w), "_k": (F.floor(F.col("start") / size) * size).cast("bigint")})
    x = x.join(binned.withColumnRenamed("start", "_k"), ["chrom", "_k"], "left")
    weak = F.col("hit").isNull() & (F.abs(F.col("_a") - F.col("score")) < within) & (F.abs(F.col("_b") - F.col("score")) < within)
    return x.where(~F.coalesce(weak, F.lit(False))).select(*domains.columns)


def relation_lines(relations: DataFrame) -> DataFrame:
    """(chrom, line): the relation tree of each chromosome as edges of the DOT language."""
    return relations.select("chrom", F.concat(F.lit('"'), F.col("parent").cast("string"), F.lit('" -> "'), F.col("child").cast("string"), F.lit('";')).alias("line"))


def differential_verdicts(tests: DataFrame, p_value: float = 0.05, mode: str = "all", how: str = "one") -> DataFrame:
    """(id, rejected): of (id, part, p) with parts intra, left and right; a missing test counts as accepted.

    ``mode`` says which parts are asked ('intra-TAD', 'left-inter-TAD', 'right-inter-TAD', 'all'),
    ``how`` whether one or all of them must reject.
    """
    parts = {"intra-TAD": ["intra"], "left-inter-TAD": ["intra", "left"], "right-inter-TAD": ["intra", "right"], "all": ["intra", "left", "right"]}[mode]
    hit = [F.max(F.when(F.col("part") == x, F.col("p") <= p_value)).alias(x) for x in parts]
    t = tests.groupBy("id").agg(*hit)
    out = F.coalesce(F.col(parts[0]), F.lit(False))
    for x in parts[1:]:
        y = F.coalesce(F.col(x), F.lit(False))
        out = out & y if how == "all" else out | y
    return t.select("id", out.alias("rejected"))


def domain_densities(pixels: DataFrame, domains: DataFrame, size: int) -> DataFrame:
    """Per domain and part (intra, left, right): sum, stored cells, possible cells and density; ratios to the sum within the domain."""
    c = X.domain_cells(pixels, domains, size)
    own = c.where("part = 'intra'").select("id", F.lit("intra").alias("part"), "value")
    sides = c.where("part = 'right'")
    every = own.union(sides.select("id", F.lit("right"), "value")).union(sides.select("id2", F.lit("left"), "value"))
    s = every.groupBy("id", "part").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("stored"))
    w = W.partitionBy("chrom").orderBy("start")
    n = domains.select("id", "chrom", "start", (F.floor((F.col("end") - 1) / size) - F.floor(F.col("start") / size) + 1).alias("k"))
    n = n.select("id", (F.col("k") * (F.col("k") + 1) / 2).alias("intra"), (F.col("k") * F.lag("k").over(w)).cast("double").alias("left"), (F.col("k") * F.lead("k").over(w)).cast("double").alias("right"))
    cells = n.select("id", F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.col(p).alias("cells")) for p in ("intra", "left", "right")])).alias("c")).select("id", "c.*").where("cells IS NOT NULL")
    out = cells.join(s, ["id", "part"], "left").na.fill(0, ["total", "stored"])
    inner = F.max(F.when(F.col("part") == "intra", F.col("total"))).over(W.partitionBy("id"))
    return out.select("id", "part", "total", "stored", "cells", (F.col("stored") / F.col("cells")).alias("density"), F.when(inner > 0, F.col("total") / inner).alias("ratio"))


def file_resolution(starts: DataFrame, rows: int = 20) -> DataFrame:
    """(resolution): the least power-of-ten part of the first starts, their last digit before trailing zeros and these; needs ``row``."""
    first = starts.orderBy("row").limit(rows)  # the feature: the first lines tell it
    tail = F.regexp_extract(F.col("start").cast("string"), r"([1-9]0*)$", 1).try_cast("bigint")
    return first.agg(F.min(tail).alias("resolution"))


# -- regions -----------------------------------------------------------------------------
def anchor_bins(regions: DataFrame, size: int, how: str = "first") -> DataFrame:
    """(row, chrom, bin_id, strand) of regions: the first, last or middle one of the bins they overlap."""
    first, last = F.floor(F.col("start") / size), F.floor((F.greatest("end", F.col("start") + 1) - 1) / size)
    at = {"first": first, "last": last, "center": F.floor((first + last) / 2)}[how]
    return regions.select("row", "chrom", (F.col("chrom") * STRIDE + at).cast("bigint").alias("bin_id"), "strand")


def anchor_pairs(a: DataFrame, b: DataFrame, mode: str = "intra-chr", least: int = 0, most: int = 1 << 40) -> DataFrame:
    """Distinct (bin1, bin2, strands) of anchors: within chromosomes and a range of bins, between chromosomes, all, or row by row.

    Strands are those of the smaller and of the larger bin; of pairs met more than once the first row's stand.
    The first rows of a bin decide for all its pairs, so bins meet, not anchors, each two of them once, and
    what they give is final: nothing is shuffled but the bins. All pairs are as many as they are, in and out.
    """
    if mode == "row-wise":
        x, y = a.select(*[F.col(c).alias(f"{c}_a") for c in ("row", "bin_id", "strand")]), b.select(*[F.col(c).alias(f"{c}_b") for c in ("row", "bin_id", "strand")])
        both = x.join(y, F.col("row_a") == F.col("row_b")).where("bin_id_a <> bin_id_b")
        turn = F.col("bin_id_a") > F.col("bin_id_b")
        strands = F.when(turn, F.concat("strand_b", "strand_a")).otherwise(F.concat("strand_a", "strand_b"))
        return both.groupBy(F.least("bin_id_a", "bin_id_b").alias("bin1"), F.greatest("bin_id_a", "bin_id_b").alias("bin2")).agg(F.min_by(strands, F.struct("row_a", "row_b")).alias("strands"))
    side = lambda x, k: x.select("bin_id", "chrom", *[F.when(F.lit(n == k), F.struct("row", "strand")).alias(n) for n in ("a", "b")])
    every = cut(side(a, "a").union(side(b, "b")).groupBy("bin_id").agg(F.min("chrom").alias("chrom"), F.min("a").alias("a"), F.min("b").alias("b")))
    n = every.count()
    p, q = (every.select(*[F.col(c).alias(f"{c}{k}") for c in ("bin_id", "chrom", "a", "b")]) for k in (1, 2))
    ok = F.col("bin_id1") < F.col("bin_id2")
    if mode == "intra-chr":
        d = F.col("bin_id2") - F.col("bin_id1")
        ok &= (F.col("chrom1") == F.col("chrom2")) & (d >= least) & (d <= most)
    elif mode == "inter-chr":
        ok &= F.col("chrom1") != F.col("chrom2")
    if mode == "intra-chr" and most < STRIDE:
        span = max(1, most)
        p = p.withColumn("_k", F.explode(F.array(F.floor(F.col("bin_id1") / span), F.floor(F.col("bin_id1") / span) + 1)))
        both = p.join(q.withColumn("_k", F.floor(F.col("bin_id2") / span)), "_k").where(ok)
    else:
        both = p.repartition(max(1, min(4096, n * n // 4_000_000)), "bin_id1").join(small(q, 400_000), ok)
    met = lambda x, y: F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.struct(F.col(f"{x}.row").alias("r"), F.col(f"{y}.row").alias("s")))
    ahead, behind = met("a1", "b2"), met("a2", "b1")
    strands = F.when(behind.isNull() | (ahead <= behind), F.concat("a1.strand", "b2.strand")).otherwise(F.concat("b1.strand", "a2.strand"))
    return both.where(ahead.isNotNull() | behind.isNotNull()).select(F.col("bin_id1").alias("bin1"), F.col("bin_id2").alias("bin2"), strands.alias("strands"))


def fitting(pairs: DataFrame, bins: DataFrame, half: int) -> DataFrame:
    """Pairs whose windows stay within the chromosomes of both bins."""
    n = F.broadcast(bins_per_chrom(bins))
    x = pairs.join(n.toDF("_c1", "_n1"), chrom_of("bin1") == F.col("_c1")).join(n.toDF("_c2", "_n2"), chrom_of("bin2") == F.col("_c2"))
    ok = [(offset_of(f"bin{k}") >= half) & (offset_of(f"bin{k}") + half < F.col(f"_n{k}")) for k in (1, 2)]
    return x.where(ok[0] & ok[1]).select(*pairs.columns)


def oriented_windows(pixels: DataFrame, pairs: DataFrame, half: int) -> DataFrame:
    """Windows of pairs with strands, turned so that both read forwards; windows of zeros go."""
    w = X.window_cells(pixels, pairs, half).join(pairs.select("bin1", "bin2", "strands"), ["bin1", "bin2"])
    s, r, c = F.col("strands"), F.col("dr"), F.col("dc")
    w = w.select(
        "bin1", "bin2", F.when(s == "-+", -r).when(s == "--", c).otherwise(r).alias("dr"), F.when(s == "+-", -c).when(s == "--", r).otherwise(c).alias("dc"), "value"
    )
    # a window is (2 half + 1) squared rows
    return w.withColumn("_t", F.sum("value").over(W.partitionBy("bin1", "bin2"))).where("_t <> 0").drop("_t")


def outlier_windows(windows: DataFrame, most: float = 2.0) -> DataFrame:
    """(bin1, bin2) of windows with a cell further from the median than ``most`` deviations (1.4826 times the median of all sizes)."""
    m = windows.agg(F.median("value").alias("m"), (1.4826 * F.median(F.abs("value"))).alias("s"))
    far = windows.crossJoin(F.broadcast(m)).where((F.col("s") > 0) & (F.abs(F.col("value") - F.col("m")) / F.col("s") > most))
    return far.select("bin1", "bin2").distinct()


def window_features(windows: DataFrame, part: str = "full", center: int = 1) -> DataFrame:
    """(bin1, bin2, features): the cells of a window in order, those near the centre or those on the diagonal."""
    ok = {"full": F.lit(True), "center": (F.abs("dr") <= center) & (F.abs("dc") <= center), "diagonal": F.col("dr") == F.col("dc")}[part]
    f = F.transform(F.array_sort(F.collect_list(F.struct("dr", "dc", "value"))), lambda s: s["value"])
    return windows.where(ok).groupBy("bin1", "bin2").agg(f.alias("features"))


def window_clusters(windows: DataFrame, k: int, part: str = "full", seed: int = 7) -> DataFrame:
    """(bin1, bin2, cluster) by k-means; clusters are numbered by their size, the largest first."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    # windows are made once, whatever number of passes the clusters take
    x = cut(window_features(windows, part)).withColumn("v", array_to_vector("features"))
    if x.limit(1).count() == 0:
        return x.select("bin1", "bin2", F.lit(0).alias("cluster"))
    found = KMeans(k=k, seed=seed, featuresCol="v", predictionCol="c").fit(x).transform(x).select("bin1", "bin2", "c")
    order = found.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("bin1", "bin2")).alias("first"))
    order = order.select("c", F.row_number().over(W.orderBy(F.desc("n"), "first")).alias("cluster"))  # k rows
    return found.join(F.broadcast(order), "c").select("bin1", "bin2", "cluster")


def linkage_order(distances: list[list[float]]) -> list[int]:
    """The order of leaves of a complete-linkage tree over a few items, nearest clusters first."""
    groups = [[k] for k in range(len(distances))]
    while len(groups) > 1:
        far = lambda a, b: max(distances[i][j] for i in a for j in b)
        i, j = min(((i, j) for i in range(len(groups)) for j in range(i + 1, len(groups))), key=lambda p: (far(groups[p[0]], groups[p[1]]), p))
        groups[i] += groups.pop(j)
    return groups[0] if groups else []


def average_regions(pixels: DataFrame, regions: DataFrame, bins: DataFrame, size: int, before: int, behind: int, at: str = "start") -> DataFrame:
    """(r, c, value): mean of the squares from ``before`` bins before to ``behind`` bins behind each region's start, end or middle.

    Squares that leave the chromosome are left out; those of ``-`` regions are transposed.
    """
    pos = {"start": F.col("start"), "end": F.col("end"), "center": F.floor((F.col("start") + F.col("end")) / 2)}[at]
    n = F.broadcast(bins_per_chrom(bins))
    a = regions.join(n, "chrom").withColumn("o", F.floor(pos / size)).where((F.col("o") >= before) & (F.col("o") + behind <= F.col("n")))
    a = a.select("row", "strand", (F.col("chrom") * STRIDE + F.col("o") - before).cast("bigint").alias("base"))
    total = a.agg(F.count(F.lit(1)).alias("k"))
    span = before + behind
    k = F.sequence(F.lit(0), F.lit(span - 1))
    cells = a.withColumn("r", F.explode(k)).withColumn("c", F.explode(k))
    cells = cells.withColumns({"bin1": F.least(F.col("base") + F.col("r"), F.col("base") + F.col("c")), "bin2": F.greatest(F.col("base") + F.col("r"), F.col("base") + F.col("c"))})
    turned = F.col("strand") == "-"
    s = cells.join(pixels, ["bin1", "bin2"]).groupBy(F.when(turned, F.col("c")).otherwise(F.col("r")).alias("r"), F.when(turned, F.col("r")).otherwise(F.col("c")).alias("c")).agg(F.sum("value").alias("s"))
    return s.crossJoin(F.broadcast(total)).select("r", "c", (F.col("s") / F.col("k")).alias("value"))


# -- capture -----------------------------------------------------------------------------
def interactions(profile: DataFrame, points: DataFrame, size: int) -> DataFrame:
    """Rows to report: chrom, start, end, gene, sum, rel_pos in bases, relative and raw, for each position of a viewpoint."""
    p = small(points.select("id", "gene", "bin_id"))
    at = (F.col("bin_id") % STRIDE + F.col("rel_pos")) * size
    total = F.sum("raw").over(W.partitionBy("id"))
    return profile.join(p, "id").select("id", F.floor(F.col("bin_id") / STRIDE).alias("chrom"), at.alias("start"), (at + size).alias("end"), "gene", total.alias("sum"), (F.col("rel_pos") * size).alias("rel_pos"), "relative", "raw")


def rbz(value: Column, mean: Column, error: Column) -> Column:
    """(value - mean) / error, -1 where that is no number."""
    return F.when(error.isNull() | (error == 0) | F.isnan(error), -1.0).otherwise((value - mean) / error)


def accepted_points(quality: DataFrame, share: float) -> DataFrame:
    """(id, verdict) of (id, sample, sparsity): 'faulty' if a sample has none (-1 or NULL), 'accepted' if any is above ``share``, else 'rejected'."""
    s = quality.groupBy("id").agg(F.min(F.coalesce("sparsity", F.lit(-1.0))).alias("lo"), F.max("sparsity").alias("hi"))
    return s.select("id", F.when(F.col("lo") < 0, "faulty").when(F.col("hi") > share, "accepted").otherwise("rejected").alias("verdict"))


def preselect(hits: DataFrame, column: str, limit: float | DataFrame, above: bool = True) -> DataFrame:
    """Rows whose ``column`` reaches a limit ('above') or stays below it, one for all or per (rel_pos, value)."""
    if isinstance(limit, DataFrame):
        x, bound = hits.join(small(limit.select("rel_pos", F.col("value").alias("_limit"))), "rel_pos"), F.col("_limit")
    else:
        x, bound = hits, F.lit(limit)
    return x.where(F.col(column) >= bound if above else F.col(column) <= bound).select(*hits.columns)


def retested(runs: DataFrame, background: DataFrame, p_value: float = 0.05, least: float = 5.0) -> DataFrame:
    """Merged runs with the tail of their summed count in the background at their strongest place, kept if small enough and with enough contacts."""
    from ..functions.stats import nb_tail

    x = runs.join(small(background.select("rel_pos", "size", "prob")), "rel_pos").withColumn("p", nb_tail("raw", "size", "prob"))
    return x.where((F.col("p") <= p_value) & (F.col("raw") >= least)).drop("size", "prob")


def by_p_value(hits: DataFrame, p_value: float, least: float, column: str = "raw") -> DataFrame:
    """Rows by p alone and enough contacts; ``column`` 'x_fold' asks the fold instead, as older tables did."""
    return hits.where((F.col("p") <= p_value) & (F.col(column) >= least))


def sample_pairs(samples: DataFrame, mode: str = "dual") -> DataFrame:
    """(sample1, sample2): all pairs, or each sample with itself ('single')."""
    s = samples.select("sample").distinct()
    a, b = s.toDF("sample1"), s.toDF("sample2")
    return a.join(F.broadcast(b), F.col("sample1") == F.col("sample2") if mode == "single" else F.col("sample1") < F.col("sample2"))  # a row per sample


def target_regions(significant: DataFrame, size: int) -> DataFrame:
    """(id, start, end): significant stretches of the samples of a viewpoint, those within a bin of one another joined."""
    return merge(significant.select(F.col("id").alias("chrom"), "start", "end"), gap=size).select(F.col("chrom").alias("id"), "start", "end")


def on_targets(interactions: DataFrame, targets: DataFrame, bucket: int = 100_000) -> DataFrame:
    """(id, t_start, t_end, n, raw): interactions summed over the first target of their viewpoint that they overlap."""
    x = range_join(interactions.select(F.col("id").alias("chrom"), "start", "end", "raw", "rel_pos"), targets.select(F.col("id").alias("chrom"), "start", "end"), bucket)
    first = x.groupBy("l").agg(F.min(F.struct("r.start", "r.end")).alias("t"))
    return first.groupBy(F.col("l.chrom").alias("id"), F.col("t.start").alias("t_start"), F.col("t.end").alias("t_end")).agg(F.count(F.lit(1)).alias("n"), F.sum("l.raw").alias("raw"))


def plain_viewpoint(pixels: DataFrame, lo: int, hi: int, first: int, last: int) -> DataFrame:
    """(bin_id, value): row sums of the bins ``lo`` to ``hi`` at the bins ``first`` to ``last``, all included."""
    m = mirror(pixels.where((F.col("bin1") <= F.lit(max(hi, last))) & (F.col("bin2") >= F.lit(min(lo, first)))))
    return m.where(F.col("bin1").between(lo, hi) & F.col("bin2").between(first, last)).groupBy(F.col("bin2").alias("bin_id")).agg(F.sum("value").alias("value"))


# -- loops -------------------------------------------------------------------------------
def loop_places(loops: DataFrame, bins: DataFrame, most: int | None = None) -> DataFrame:
    """Loops as places of the genome, those further apart than ``most`` bases left out."""
    b = small(bins.select("bin_id", "chrom", "start", "end"))
    x = loops.join(b.toDF("bin1", "chrom1", "start1", "end1"), "bin1").join(b.toDF("bin2", "chrom2", "start2", "end2"), "bin2")
    x = x if most is None else x.where(F.col("start2") - F.col("start1") <= most)
    return x.select("chrom1", "start1", "end1", "chrom2", "start2", "end2", *[c for c in loops.columns if c not in ("bin1", "bin2")])


def loops_with_contacts(loops: DataFrame, pixels: DataFrame, size: int) -> DataFrame:
    """Loops (id and two anchors) with a stored contact in the rectangle of their anchors."""
    span = lambda k: F.explode(F.sequence(F.floor(F.col(f"start{k}") / size), F.floor((F.col(f"end{k}") - 1) / size)))
    cells = loops.withColumn("_i", span(1)).withColumn("_j", span(2))
    a, b = (F.col("chrom1") * STRIDE + F.col("_i")).cast("bigint"), (F.col("chrom2") * STRIDE + F.col("_j")).cast("bigint")
    cells = cells.select("id", F.least(a, b).alias("bin1"), F.greatest(a, b).alias("bin2"))
    return loops.join(cells.join(pixels.where("value <> 0"), ["bin1", "bin2"], "left_semi").select("id").distinct(), "id", "left_semi")


def boundaries_with_peaks(boundaries: DataFrame, peaks: DataFrame, size: int) -> DataFrame:
    """Boundaries (chrom, start, end, id) that overlap a binned peak."""
    from .intervals import semi, snap

    return semi(boundaries.select("chrom", "start", "end", "id"), merge(snap(peaks, size)).select("chrom", "start", "end"), 100_000)


def search(options: dict[str, list], score) -> list[tuple[float, dict]]:
    """All combinations of ``options`` with ``score(**combination)``, the best first: a loop on the driver over jobs, not over rows."""
    import itertools

    found = [(float(score(**(o := dict(zip(options, v, strict=True))))), o) for v in itertools.product(*options.values())]
    return sorted(found, key=lambda x: (-x[0], sorted(x[1].items())))


# -- tracks and marks --------------------------------------------------------------------
def flip_by_mark(track: DataFrame, mark: DataFrame, active: bool = True) -> DataFrame:
    """A track negated in the chromosomes where the mark (bin_id, signal) is larger on its other side; both sides must have a signal."""
    x = track.join(mark, "bin_id", "left").withColumn("chrom", chrom_of("bin_id")).withColumn("signal", F.coalesce("signal", F.lit(0.0)))
    m = x.groupBy("chrom").agg(F.avg(F.when(F.col("value") > 0, F.col("signal"))).alias("up"), F.avg(F.when(F.col("value") < 0, F.col("signal"))).alias("down"))
    wrong = F.col("up") < F.col("down") if active else F.col("up") > F.col("down")
    flip = F.coalesce(wrong & (F.col("up") != 0) & (F.col("down") != 0), F.lit(False))
    return x.join(F.broadcast(m), "chrom").select("bin_id", F.when(flip, -F.col("value")).otherwise(F.col("value")).alias("value"))  # a row per chromosome


def trimmed_quantiles(track: DataFrame, q: int, percent: float) -> DataFrame:
    """(bin_id, q): how many of q even steps between the ``percent`` and 100 - ``percent`` percentiles are at most the value."""
    e = track.agg(F.percentile("value", F.array(F.lit(percent / 100), F.lit(1 - percent / 100))).alias("e"))
    steps = F.transform(F.sequence(F.lit(0), F.lit(q - 1)), lambda k: F.col("e")[0] + (F.col("e")[1] - F.col("e")[0]) * k / (q - 1))
    return track.crossJoin(F.broadcast(e)).select("bin_id", F.size(F.filter(steps, lambda x: x <= F.col("value"))).cast("bigint").alias("q"))


def suggested_threshold(values: DataFrame, parts: int = 100) -> DataFrame:
    """(threshold): the lower edge of the first local minimum of a histogram of ``total``, NULL without one; a row per part is ranked."""
    r = values.agg(F.min("total").alias("lo"), F.max("total").alias("hi"))
    x = values.crossJoin(F.broadcast(r)).where("hi > lo")
    k = F.least(F.floor((F.col("total") - F.col("lo")) / (F.col("hi") - F.col("lo")) * parts), F.lit(parts - 1)).cast("int")
    n = x.groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    every = values.sparkSession.range(parts).select(F.col("id").cast("int").alias("k")).join(n, "k", "left").na.fill(0, ["n"])
    w = W.orderBy("k")
    low = every.withColumns({"a": F.lag("n").over(w), "b": F.lead("n").over(w)}).where("a > n AND n < b").agg(F.min("k").alias("k"))
    return low.crossJoin(r).select((F.col("lo") + F.col("k") * (F.col("hi") - F.col("lo")) / parts).alias("threshold"))


def without_outliers(values: DataFrame, column: str, most: float = 3.5) -> DataFrame:
    """Rows within ``most`` deviations (1.4826 times the median of distances) of the median; all if that is zero."""
    m = values.agg(F.median(column).alias("_m"))
    x = values.crossJoin(F.broadcast(m))
    s = x.agg((1.4826 * F.median(F.abs(F.col(column) - F.col("_m")))).alias("_s"))
    return x.crossJoin(F.broadcast(s)).where("_s = 0 OR abs({c} - _m) / _s <= {t}".format(c=column, t=most)).select(*values.columns)


def rescaled(value: Column, lo: Column, hi: Column, to_lo: float = 0.0, to_hi: float = 1.0) -> Column:
    return to_lo + (value - lo) * (to_hi - to_lo) / (hi - lo)


def transform(pixels: DataFrame, bins: DataFrame, method: str = "obs_exp", per_chrom: bool = False) -> DataFrame:
    """One of the matrix transforms by name, over the genome or chromosome by chromosome."""
    from . import matrix as M

    if method in ("pearson", "covariance"):
        return M.covariance(pixels, bins, method == "pearson")
    name = {"obs_exp": "mean", "obs_exp_lieberman": "lieberman", "obs_exp_non_zero": "non_zero"}[method]
    if not per_chrom:
        return M.obs_exp(pixels, bins, name)
    names = [r[0] for r in bins.select("chrom").distinct().orderBy("chrom").collect()]  # chromosomes
    out = None
    for c in names:
        one = M.obs_exp(pixels.where((chrom_of("bin1") == c) & (chrom_of("bin2") == c)), bins.where(F.col("chrom") == c), name)
        out = one if out is None else out.unionByName(one)
    return pixels.limit(0) if out is None else out


# -- boundary learning -------------------------------------------------------------------
def near_labels(features: DataFrame, domains: DataFrame, size: int, leniency: int = 0) -> DataFrame:
    """(bin_id, features, label): 1 where a domain starts within ``leniency`` bins."""
    at = (F.col("chrom") * STRIDE + F.floor(F.col("start") / size)).cast("bigint")
    hit = domains.select(F.explode(F.sequence(at - leniency, at + leniency)).alias("bin_id")).distinct().withColumn("label", F.lit(1.0))
    return features.join(hit, "bin_id", "left").na.fill(0.0, ["label"])


def undersampled(rows: DataFrame, seed: int = 7) -> DataFrame:
    """As many rows of the larger class as the smaller has, those with the least hash."""
    n = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    least = n.agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("kinds"))
    h = F.xxhash64("bin_id", F.lit(seed))
    share = F.col("least") / F.col("n")
    x = rows.join(F.broadcast(n), "label").crossJoin(F.broadcast(least)).where("kinds = 2")
    return x.where(F.pmod(h, F.lit(1 << 30)) < share * (1 << 30)).select(*rows.columns)


def centroids(rows: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """The larger class as the centres of ``k`` clusters: (features, label)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    few, many = rows.where("label = 1"), rows.where("label = 0")
    fit = KMeans(k=k, seed=seed, featuresCol="v").fit(many.withColumn("v", array_to_vector("features")))
    centers = rows.sparkSession.createDataFrame([([float(v) for v in c], 0.0) for c in fit.clusterCenters()], "features array<double>, label double")  # k rows
    return few.select("features", "label").union(centers)


def bag_of_boosted(rows: DataFrame, models: int = 3, rounds: int = 5, seed: int = 7) -> list:
    """Boosted trees on ``models`` samples of the rows drawn by hash; none without both classes."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    x = rows.withColumn("features", array_to_vector("features"))
    out = []
    for k in range(models):
        part = x.where(F.pmod(F.xxhash64("bin_id", F.lit(seed + k)), F.lit(10)) < 8)
        if part.select("label").distinct().count() == 2:
            out.append(GBTClassifier(maxIter=rounds, maxDepth=4, seed=seed + k).fit(part))
    return out


def vote(models: list, features: DataFrame) -> DataFrame:
    """(bin_id, share, boundary): the share of models that see a boundary, and whether it is above a half."""
    from pyspark.ml.functions import array_to_vector

    x = features.select("bin_id", array_to_vector("features").alias("features"))
    for k, m in enumerate(models):
        x = m.transform(x).withColumnRenamed("prediction", f"_p{k}").drop("rawPrediction", "probability")
    s = F.lit(0.0)
    for k in range(len(models)):
        s = s + F.col(f"_p{k}")
    s = s / max(1, len(models))
    return x.select("bin_id", s.alias("share"), (s > 0.5).cast("int").alias("boundary"))


def predicted_domains(boundaries: DataFrame, size: int, least: int = 49_999) -> DataFrame:
    """Domains between predicted boundary bins of a chromosome; borders closer than ``least`` to the one before go."""
    b = boundaries.where("boundary = 1").select(chrom_of("bin_id").alias("chrom"), (offset_of("bin_id") * size).alias("pos"))
    w = W.partitionBy("chrom").orderBy("pos")
    kept = b.withColumn("_b", F.lag("pos").over(w)).where(F.col("_b").isNull() | (F.col("_b") + least <= F.col("pos"))).drop("_b")
    return X.domains_of(kept.withColumn("score", F.lit(1.0))).select("chrom", "start", "end", "k")


def confusion(rows: DataFrame) -> DataFrame:
    """One row of (label, boundary): counts of the four cases, accuracy, precision, recall and f1."""
    y, p = F.col("label") == 1, F.col("boundary") == 1
    t = rows.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    safe = lambda a, b: F.when(b > 0, a / b)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return t.select("*", safe(tp + tn, tp + fp + fn + tn).alias("accuracy"), safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"))


# -- shown tables ------------------------------------------------------------------------
def shown_matrix(pixels: DataFrame, lo1: int, hi1: int, lo2: int, hi2: int, log: bool = False) -> DataFrame:
    """(bin1, bin2, value) of the dense rectangle of two bin ranges; with ``log`` zeros take the least positive value first."""
    spark = pixels.sparkSession
    cells = spark.range(lo1, hi1 + 1).toDF("x").withColumn("y", F.explode(F.sequence(F.lit(lo2).cast("bigint"), F.lit(hi2).cast("bigint"))))
    cells = cells.withColumns({"bin1": F.least("x", "y"), "bin2": F.greatest("x", "y")}).join(pixels, ["bin1", "bin2"], "left")
    x = cells.select(F.col("x").alias("bin1"), F.col("y").alias("bin2"), F.coalesce("value", F.lit(0.0)).alias("value"))
    if not log:
        return x
    least = x.where("value > 0").agg(F.min("value").alias("_m"))
    return x.crossJoin(F.broadcast(least)).select("bin1", "bin2", F.log(F.greatest("value", "_m")).alias("value"))


def stored_or_made(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at ``path`` if it is there, else what ``make()`` gives, written there first."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        make().write.parquet(path)
    return spark.read.parquet(path)


def moving_sum(track: DataFrame, reach: int) -> DataFrame:
    """Adds ``around``: the sum of ``value`` within ``reach`` bases either side of ``start``, a frame by position and not by rows."""
    w = W.partitionBy("chrom").orderBy("start").rangeBetween(-reach, reach)
    return track.withColumn("around", F.sum("value").over(w))


def last_before(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """As-of join: ``left`` with the latest ``value`` of ``right`` at or before its ``at``; both sides run through one window, no pairs are made."""
    a = left.select(by, at, F.struct(*left.columns).alias("_l"), F.lit(1).alias("_o"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    b = right.select(by, at, F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), F.lit(0).alias("_o"), F.col(value).alias("_v"))
    w = W.partitionBy(by).orderBy(at, "_o", "_v").rowsBetween(W.unboundedPreceding, 0)
    x = a.union(b).withColumn("_last", F.last("_v", ignorenulls=True).over(w))
    return x.where("_o = 1").select("_l.*", F.col("_last").alias(value))
