"""Domains, loops, compartments, pile-ups and viewpoints over pixels."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..frames import STRIDE, bins_per_chrom, chrom_of, dist, intra, mirror, offset_of, small
from ..functions.stats import fisher_p, nb_cdf, nb_fit, p_of_chi2, p_of_z
from .intervals import merge, range_join, semi, snap


# -- statistics in relational form -------------------------------------------------------
def rank_sum(values: DataFrame, keys: list[str], side: str = "side", value: str = "value") -> DataFrame:
    """(keys, n1, n2, z, p) of sides 1 and 2: equal values are counted together, so a window holds different values only."""
    t = values.groupBy(*keys, value).agg(F.count_if(F.col(side) == 1).alias("a"), F.count_if(F.col(side) == 2).alias("b"))
    w = W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    both = F.col("a") + F.col("b")
    t = t.withColumn("r", F.sum(both).over(w) - (both - 1) / 2)
    s = t.groupBy(*keys).agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.sum(F.col("a") * F.col("r")).alias("w"))
    n = F.col("n1") + F.col("n2") + 1
    z = (F.col("w") - F.col("n1") * n / 2) / F.sqrt(F.col("n1") * F.col("n2") * n / 12)
    return s.where("n1 > 0 AND n2 > 0").select(*keys, "n1", "n2", z.alias("z")).withColumn("p", p_of_z("z"))


def running_count(counts: DataFrame, value: str, slices: int = 1024) -> DataFrame:
    """Adds ``upto``: the sum of ``c`` over the values up to each; ranges of values are summed apart and then follow one another."""
    cuts = counts.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    slice_ = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * slices)).otherwise(0).cast("int")
    x = counts.crossJoin(F.broadcast(cuts)).withColumn("_s", slice_).drop("_lo", "_hi")
    parts = x.groupBy("_s").agg(F.sum("c").alias("_t"))
    before = parts.select("_s", (F.sum("_t").over(W.orderBy("_s").rowsBetween(W.unboundedPreceding, 0)) - F.col("_t")).alias("_o"))  # a row per slice
    own = F.sum("c").over(W.partitionBy("_s").orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    return x.withColumn("_own", own).join(F.broadcast(before), "_s").withColumn("upto", F.col("_own") + F.col("_o")).drop("_s", "_own", "_o")


def benjamini_hochberg(df: DataFrame, p: str, q: float) -> DataFrame:
    """Adds ``significant``: p up to the largest p with p <= q * rank / n. Equal p are counted before they are ranked."""
    c = df.groupBy(p).agg(F.count(F.lit(1)).alias("c"))
    total = df.agg(F.count(F.lit(1)).alias("n"))
    ranked = running_count(c, p).crossJoin(F.broadcast(total))
    limit = ranked.where(F.col(p) <= q * F.col("upto") / F.col("n")).agg(F.max(p).alias("limit"))
    return df.crossJoin(F.broadcast(limit)).withColumn("significant", F.coalesce(F.col(p) <= F.col("limit"), F.lit(False))).drop("limit")


# -- domains -----------------------------------------------------------------------------
def diamonds(pixels: DataFrame, bins: DataFrame, widths: list[int]) -> DataFrame:
    """(bin_id, w, score): mean of the rectangle between w bins left and w bins right of a cut, absent cells as zero."""
    most = max(widths)
    px = pixels.where(intra() & (dist() > 0) & (dist() < 2 * most))
    w = F.explode(F.array(*[F.lit(x) for x in widths]))
    t = px.select("bin1", "bin2", "value", w.alias("w")).where(F.col("bin2") - F.col("bin1") < 2 * F.col("w"))
    lo, hi = F.greatest(F.col("bin1") + 1, F.col("bin2") - F.col("w") + 1), F.least(F.col("bin2"), F.col("bin1") + F.col("w"))
    s = t.where(lo <= hi).select(F.explode(F.sequence(lo, hi)).alias("bin_id"), "w", "value").groupBy("bin_id", "w").agg(F.sum("value").alias("s"))
    every = bins.where(offset_of("bin_id") > 0).join(F.broadcast(bins_per_chrom(bins)), "chrom").select("bin_id", "n", w.alias("w"))
    area = F.least("w", offset_of("bin_id")) * F.least(F.col("w"), F.col("n") - offset_of("bin_id"))
    return every.join(s, ["bin_id", "w"], "left").select("bin_id", "w", (F.coalesce("s", F.lit(0.0)) / area).alias("score"))


def mean_score(scores: DataFrame) -> DataFrame:
    return scores.groupBy("bin_id").agg(F.avg("score").alias("score"))


def deltas(scores: DataFrame, reach: int = 10) -> DataFrame:
    """Adds ``delta``: the mean of ``reach`` bins either side without the third after, less the score; NULL near the borders."""
    w = W.partitionBy(chrom_of("bin_id")).orderBy("bin_id")
    around = w.rowsBetween(-reach, reach - 1)
    out = (F.sum("score").over(around) - F.lead("score", 3).over(w)) / (2 * reach - 1) - F.col("score")
    return scores.withColumn("delta", F.when((F.lag("score", reach).over(w).isNotNull()) & (F.lead("score", reach - 1).over(w).isNotNull()), out))


def valleys(scores: DataFrame, look: int = 4, delta: float = 0.0) -> DataFrame:
    """(bin_id, score, kind): peaks and valleys by turns, from a scan that looks ahead and starts anew in each chromosome.

    The look ahead reaches into the next chromosome; the genome's last ``look`` rows are
    not scanned, and the first place found in the genome is not kept. A sequential scan has a
    state, so each chromosome's scores are one group: a row per bin, bounded by the genome.
    """
    x = scores.select("bin_id", "score", chrom_of("bin_id").alias("chrom"))
    names = [r[0] for r in x.select("chrom").distinct().orderBy("chrom").collect()]  # chromosomes
    if not names:
        return x.select("bin_id", "score", F.lit("").alias("kind"))
    # the first rows of a chromosome also follow the one before it
    order = F.broadcast(scores.sparkSession.createDataFrame(list(zip(names[1:], names[:-1], strict=True)), "chrom bigint, before bigint"))
    head = x.withColumn("_k", F.row_number().over(W.partitionBy("chrom").orderBy("bin_id"))).where(F.col("_k") <= look).join(order, "chrom")
    rows = x.withColumn("tail", F.lit(False)).union(head.select("bin_id", "score", F.col("before").alias("chrom"), F.lit(True)))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["tail", "bin_id"])
        y, ids, own = t["score"].to_numpy(), t["bin_id"].to_numpy(), int((~t["tail"]).sum())
        found = []
        high = low = 0
        top, bottom, wanted = -np.inf, np.inf, None
        for k in range(min(own, max(0, len(y) - look)) if own == len(y) else own):
            if y[k] > top:
                top, high = y[k], k
            if y[k] < bottom:
                bottom, low = y[k], k
            ahead = y[k : k + look]
            if wanted != "valley" and y[k] < top - delta and ahead.max() < top:
                found.append((ids[high], y[high], "peak", k))
                top, bottom, low, wanted = y[k], y[k], k, "valley"
            elif wanted != "peak" and y[k] > bottom + delta and ahead.min() > bottom:
                found.append((ids[low], y[low], "valley", k))
                top, bottom, high, wanted = y[k], y[k], k, "peak"
        return pd.DataFrame([(*f, int(t["chrom"].iloc[0])) for f in found], columns=["bin_id", "score", "kind", "at", "chrom"])

    hits = rows.groupBy("chrom").applyInPandas(run, "bin_id bigint, score double, kind string, at bigint, chrom bigint")
    first = hits.agg(F.min(F.struct("chrom", "at")).alias("first"))
    return hits.crossJoin(F.broadcast(first)).where(F.struct("chrom", "at") != F.col("first")).select("bin_id", "score", "kind")


def domains_of(boundaries: DataFrame) -> DataFrame:
    """Consecutive boundaries (chrom, pos, score) of a chromosome: (chrom, start, end, score, k)."""
    w = W.partitionBy("chrom").orderBy("pos")
    return boundaries.select("chrom", F.col("pos").alias("start"), F.lead("pos").over(w).alias("end"), "score", F.row_number().over(w).alias("k")).where("end IS NOT NULL")


def merge_domain_lists(a: DataFrame, b: DataFrame, value: int = 5000) -> DataFrame:
    """Both lists, without the domains of ``b`` whose borders both lie within ``value`` of one of ``a``."""
    same = range_join(b, a, 100_000, slack=value).where((F.abs(F.col("l.start") - F.col("r.start")) <= value) & (F.abs(F.col("l.end") - F.col("r.end")) <= value))
    gone = same.select(F.col("l.id").alias("id")).distinct()
    return a.unionByName(b.join(gone, "id", "left_anti").select(*a.columns))


def domain_relations(d: DataFrame, share: float = 0.5) -> DataFrame:
    """(parent, child, chrom): the smaller of two domains that share ``share`` of it, or are one in the other."""
    x = range_join(d, d, 100_000).where("l.id <> r.id")
    size = lambda s: F.col(f"{s}.end") - F.col(f"{s}.start")
    both = F.least("l.end", "r.end") - F.greatest("l.start", "r.start")
    ok = (both >= share * size("r")) & ((size("l") > size("r")) | ((size("l") == size("r")) & (F.col("l.id") < F.col("r.id"))))
    return x.where(ok).select(F.col("l.id").alias("parent"), F.col("r.id").alias("child"), F.col("l.chrom").alias("chrom"))


def peaks_per_bin(peaks: DataFrame, size: int, least: int) -> DataFrame:
    return peaks.groupBy("chrom", (F.floor(F.col("start") / size) * size).alias("start")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def domain_cells(pixels: DataFrame, domains: DataFrame, size: int) -> DataFrame:
    """Pixels with their domain and whether they lie within it ('intra') or between it and the next ('right')."""
    w = W.partitionBy("chrom").orderBy("start")
    b = domains.select("chrom", "id", F.floor(F.col("start") / size).alias("lo"), F.floor((F.col("end") - 1) / size).alias("hi"), F.row_number().over(w).alias("k"))
    per = small(b.select(F.explode(F.sequence(F.col("chrom") * STRIDE + F.col("lo"), F.col("chrom") * STRIDE + F.col("hi"))).alias("bin_id"), "id", "k"))
    x = pixels.where(intra()).join(per.toDF("bin1", "id", "k1"), "bin1").join(per.toDF("bin2", "id2", "k2"), "bin2").where("k2 - k1 BETWEEN 0 AND 1")
    return x.select("id", "id2", F.when(F.col("k1") == F.col("k2"), "intra").otherwise("right").alias("part"), "bin1", "bin2", "value")


def inter_intra(pixels: DataFrame, domains: DataFrame, size: int) -> DataFrame:
    """(id, intra, inter_left, inter_right, ratio): sums over a domain and between it and its neighbours."""
    c = domain_cells(pixels, domains, size)
    here = c.groupBy("id").agg(F.sum(F.when(F.col("part") == "intra", F.col("value")).otherwise(0.0)).alias("intra"), F.sum(F.when(F.col("part") == "right", F.col("value")).otherwise(0.0)).alias("inter_right"))
    left = c.where("part = 'right'").groupBy(F.col("id2").alias("id")).agg(F.sum("value").alias("inter_left"))
    out = here.join(left, "id", "left").select("id", "intra", F.coalesce("inter_left", F.lit(0.0)).alias("inter_left"), "inter_right")
    return out.withColumn("ratio", F.when(F.col("intra") > 0, (F.col("inter_left") + F.col("inter_right")) / F.col("intra")))


def differential_domains(target: DataFrame, control: DataFrame, domains: DataFrame, size: int) -> DataFrame:
    """(id, part, n1, n2, z, p): rank sums of the stored cells of target and control per domain and part."""
    x = domain_cells(target, domains, size).withColumn("side", F.lit(1)).unionByName(domain_cells(control, domains, size).withColumn("side", F.lit(2)))
    parts = x.select("id", "part", "side", "value").union(x.where("part = 'right'").select("id2", F.lit("left"), "side", "value"))
    return rank_sum(parts, ["id", "part"])


# -- loops -------------------------------------------------------------------------------
def loop_candidates(pixels: DataFrame, ratios: DataFrame, max_bins: int, least: float = 10, ratio: float = 1.5, p: float | None = None) -> DataFrame:
    """Upper cells off the diagonal, near enough, with count and ratio; with ``p`` also a negative binomial tail per distance."""
    x = pixels.where(intra() & (dist() > 0) & (dist() <= max_bins)).join(ratios.withColumnRenamed("value", "ratio"), ["bin1", "bin2"])
    if p is None:
        return x.where((F.col("value") >= least) & (F.col("ratio") >= ratio))

    def tail(t: pd.DataFrame) -> pd.DataFrame:
        size, prob = nb_fit(t["ratio"].to_numpy())
        good = t[(t["value"] >= least) & (t["ratio"] >= ratio)].copy()
        good["p"] = [1 - nb_cdf(v, size, prob) for v in good["ratio"]]
        return good[good["p"] <= p][["bin1", "bin2", "value", "ratio", "p"]]

    return x.groupBy(dist().alias("d")).applyInPandas(tail, "bin1 bigint, bin2 bigint, value double, ratio double, p double")


def local_maxima(candidates: DataFrame, half: int = 5) -> DataFrame:
    """Candidates with the largest value of their square (ties: all), by a grid of squares as in a range join."""
    side = 2 * half + 1
    key = lambda c, k: F.floor((F.col(c) + k) / side)
    around = candidates.select(F.explode(F.array_distinct(F.array(*[F.struct(key("bin1", i).alias("g"), key("bin2", j).alias("h")) for i in (-half, half) for j in (-half, half)]))).alias("k"), "bin1", "bin2", "value")
    here = candidates.select(F.struct(key("bin1", 0).alias("g"), key("bin2", 0).alias("h")).alias("k"), F.col("bin1").alias("x"), F.col("bin2").alias("y"), F.col("value").alias("v"))
    near = around.join(here, "k").where((F.abs(F.col("x") - F.col("bin1")) <= half) & (F.abs(F.col("y") - F.col("bin2")) <= half))
    best = near.groupBy("bin1", "bin2").agg(F.max("v").alias("best"))
    return candidates.join(best, ["bin1", "bin2"]).where(F.col("value") >= F.col("best")).drop("best")


def window_cells(pixels: DataFrame, centers: DataFrame, half: int) -> DataFrame:
    """All cells of the squares around (bin1, bin2), absent ones as zero: (bin1, bin2, dr, dc, value)."""
    o = F.sequence(F.lit(-half), F.lit(half))
    c = centers.select("bin1", "bin2").distinct().select("bin1", "bin2", F.explode(o).alias("dr")).select("bin1", "bin2", "dr", F.explode(o).alias("dc"))
    c = c.withColumns({"i": F.least(F.col("bin1") + F.col("dr"), F.col("bin2") + F.col("dc")), "j": F.greatest(F.col("bin1") + F.col("dr"), F.col("bin2") + F.col("dc"))})
    return c.join(pixels.toDF("i", "j", "value"), ["i", "j"], "left").select("bin1", "bin2", "dr", "dc", F.coalesce("value", F.lit(0.0)).alias("value"))


def loop_tests(pixels: DataFrame, candidates: DataFrame, peak: int = 2, half: int = 5) -> DataFrame:
    """Rank sums of the peak square against the rest of the window: (bin1, bin2, n1, n2, z, p)."""
    side = F.when((F.abs("dr") <= peak) & (F.abs("dc") <= peak), 1).otherwise(2)
    return rank_sum(window_cells(pixels, candidates, half).withColumn("side", side), ["bin1", "bin2"])


def merge_loops(loops: DataFrame, within: int, bucket: int = 10_000) -> DataFrame:
    """Loops (chrom1, start1, end1, chrom2, start2, end2) that no overlapping loop with a wider second anchor covers; doubles vanish.

    The loops of a stretch are tried from the widest on against those not yet covered, so a dense stretch
    costs its loops times those that it takes to cover them, and no pairs are made.
    """
    keys = ["chrom1", "start1", "end1", "chrom2", "start2", "end2"]
    once = loops.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).where("c = 1").drop("c")
    at = lambda c: F.floor(c / bucket)
    dealt = once.withColumn("_k", F.explode(F.sequence(at(F.col("start1") - within), at(F.col("end1") + within))))

    def run(t: pa.Table) -> pa.Table:
        s1, e1, s2, e2 = (t.column(c).to_numpy() for c in ("start1", "end1", "start2", "end2"))
        order = np.lexsort((e1, s2, s1, s2 - e2))
        s1, e1, s2, e2 = s1[order], e1[order], s2[order], e2[order]
        gone, left = np.zeros(len(order), bool), np.arange(len(order))
        for lo in range(0, len(order), 64):
            left = left[(left > lo) & ~gone[left]]
            if not len(left):
                break
            r = np.arange(lo, min(lo + 64, len(order)))[:, None]
            near = (s1[left] - within < e1[r]) & (s1[r] < e1[left] + within) & (s2[left] - within < e2[r]) & (s2[r] - within < e2[left]) & (r < left)
            gone[left[near.any(axis=0)]] = True
        return t.select(keys).take(pa.array(order[gone]))

    gone = dealt.groupBy("chrom1", "chrom2", "_k").applyInArrow(run, once.select(*keys).schema).distinct()
    return once.join(gone, keys, "left_anti")


def validate_loops(loops: DataFrame, peaks: DataFrame, size: int) -> DataFrame:
    """Loops whose two anchors both overlap a binned peak."""
    p = merge(snap(peaks, size)).select("chrom", "start", "end")
    anchor = lambda k: loops.select("id", F.col(f"chrom{k}").alias("chrom"), F.col(f"start{k}").alias("start"), F.col(f"end{k}").alias("end"))
    ok = [semi(anchor(k), p, 100_000).select("id") for k in (1, 2)]
    return loops.join(ok[0], "id", "left_semi").join(ok[1], "id", "left_semi")


# -- compartments ------------------------------------------------------------------------
#: Bins of a chromosome up to which its dense matrix is one task's: half a GB of doubles.
DENSE = 8192


def eigenvectors(pixels: DataFrame, bins: DataFrame, k: int = 2, dense: int = DENSE) -> DataFrame:
    """(bin_id, k, value): leading eigenvectors of the covariance of each chromosome, the largest entry positive.

    Chromosomes of up to ``dense`` bins are solved by dense algebra, one a task; longer
    ones by power iteration, with sparse products over the whole cluster.
    """
    from .matrix import obs_exp

    n = bins_per_chrom(bins)
    x = mirror(obs_exp(pixels, bins, "non_zero")).withColumn("chrom", chrom_of("bin1")).join(F.broadcast(n), "chrom")

    def run(t: pd.DataFrame) -> pd.DataFrame:
        m = int(t["n"].iloc[0])
        a = np.zeros((m, m))
        a[(t["bin1"] % STRIDE).to_numpy(), (t["bin2"] % STRIDE).to_numpy()] = t["value"]
        value, vector = np.linalg.eigh(np.cov(a))
        out = []
        for j in range(min(k, m)):
            v = vector[:, -1 - j]
            v = v * np.sign(v[np.abs(v).argmax()])
            out.append(pd.DataFrame({"bin_id": int(t["chrom"].iloc[0]) * STRIDE + np.arange(m), "k": j + 1, "value": v}))
        return pd.concat(out)

    out = x.where(F.col("n") <= dense).groupBy("chrom").applyInPandas(run, "bin_id bigint, k int, value double")
    if n.where(F.col("n") > dense).limit(1).count() == 0:
        return out
    long = n.where(F.col("n") > dense)
    cells = obs_exp(pixels, bins, "non_zero").join(F.broadcast(long.withColumnRenamed("chrom", "_c")), chrom_of("bin1") == F.col("_c"), "left_semi")
    every = bins.join(F.broadcast(long), "chrom").select("bin_id")
    for j, vector in enumerate(_power(cells, {r["chrom"]: r["n"] for r in long.collect()}, k)):  # a row per chromosome
        out = out.union(every.join(small(vector), "bin_id", "left").select("bin_id", F.lit(j + 1).alias("k"), F.coalesce("value", F.lit(0.0)).alias("value")))
    return out


def _power(cells: DataFrame, sizes: dict[int, int], k: int, rounds: int = 200, tolerance: float = 1e-7) -> list[DataFrame]:
    """k times (bin_id, value): the leading eigenvectors per chromosome of the rows' covariance, each orthogonal to those before.

    Cells are made and packed once; a product is one pass over them. Bins without cells have 0.
    """
    from .matrix import packed_rows, rows_times

    ids, sums, blocks = packed_rows(cells)
    chroms, unit = np.unique(ids // STRIDE, return_inverse=True)
    n = np.array([sizes[c] for c in chroms.tolist()], float)
    per = lambda x: np.bincount(unit, x, minlength=len(n))  # noqa: E731  a sum per chromosome
    mean, empty = sums / n[unit] if len(ids) else sums, n - per(np.ones(len(ids)))
    found: list[np.ndarray] = []

    def scaled(v: np.ndarray) -> np.ndarray:
        for w in found:
            v = v - per(v * w)[unit] * w
        q = per(v * v)[unit]
        return np.divide(v, np.sqrt(q), out=np.zeros(len(v)), where=q > 0)

    for j in range(k):
        v = scaled(np.random.default_rng(j + 1).uniform(-1, 1, len(ids)))
        for _ in range(rounds if len(ids) else 0):
            # (A - m 1')(A - m 1')' v = A u - m (1' u) with u = A v - (m' v) 1, also in empty bins
            mv = per(mean * v)
            u = rows_times(blocks, v)[0] - mv[unit]
            new = scaled(rows_times(blocks, u)[0] - mean * (per(u) - empty * mv)[unit])
            off, v = np.abs(new - v).max(), new
            if off < tolerance:
                break
        for c in range(len(n)):
            own = unit == c
            v[own] *= np.sign(v[own][np.abs(v[own]).argmax()])
        found.append(v)
    return [cells.sparkSession.createDataFrame(pa.table({"bin_id": pa.array(ids, pa.int64()), "value": pa.array(v, pa.float64())})) for v in found]


def flip_sign(track: DataFrame, density: DataFrame) -> DataFrame:
    """A track (bin_id, value), negated in the chromosomes where it falls as ``density`` (bin_id, n) grows."""
    x = track.join(density, "bin_id", "left").withColumn("chrom", chrom_of("bin_id")).withColumn("n", F.coalesce("n", F.lit(0)))
    r = x.groupBy("chrom").agg(F.covar_pop("value", "n").alias("r"))  # the sign of the correlation, where it has one
    return x.join(F.broadcast(r), "chrom").select("bin_id", F.when(F.col("r") < 0, -F.col("value")).otherwise(F.col("value")).alias("value"))


def quantile_of(track: DataFrame, q: int) -> DataFrame:
    """(bin_id, q): how many of q evenly spaced exact quantiles are at most the value."""
    edges = track.agg(F.percentile("value", F.array(*[F.lit(k / (q - 1)) for k in range(q)])).alias("e"))
    return track.crossJoin(F.broadcast(edges)).select("bin_id", F.size(F.filter("e", lambda x: x <= F.col("value"))).cast("bigint").alias("q"))


def saddle(obsexp: DataFrame, quantiles: DataFrame) -> DataFrame:
    """(q1, q2, mean) over all cells of a chromosome's bins, absent ones as zero; cells are counted, not made."""
    qs = small(quantiles)
    n = quantiles.groupBy(chrom_of("bin_id").alias("chrom"), "q").agg(F.count(F.lit(1)).alias("n"))
    cells = n.toDF("chrom", "q1", "n1").join(n.toDF("chrom", "q2", "n2"), "chrom").groupBy("q1", "q2").agg(F.sum(F.col("n1") * F.col("n2")).alias("cells"))
    m = mirror(obsexp.where(intra())).join(qs.toDF("bin1", "q1"), "bin1").join(qs.toDF("bin2", "q2"), "bin2").groupBy("q1", "q2").agg(F.sum("value").alias("s"))
    return cells.join(m, ["q1", "q2"], "left").select("q1", "q2", (F.coalesce("s", F.lit(0.0)) / F.col("cells")).alias("mean"), "cells")


def polarization(s: DataFrame, q: int) -> DataFrame:
    """(k, ratio): same over different corners of the first and last k quantiles."""
    ks = s.sparkSession.range(1, q).select(F.col("id").alias("k"))
    lo1, lo2, hi1, hi2 = F.col("q1") <= F.col("k"), F.col("q2") <= F.col("k"), F.col("q1") > q - F.col("k"), F.col("q2") > q - F.col("k")
    within, between = (lo1 & lo2) | (hi1 & hi2), (lo1 & hi2) | (hi1 & lo2)
    x = s.crossJoin(F.broadcast(ks)).groupBy("k").agg(F.sum(F.when(within, F.col("mean")).otherwise(0.0)).alias("w"), F.sum(F.when(between, F.col("mean")).otherwise(0.0)).alias("b"))
    return x.where("b > 0").select("k", (F.col("w") / F.col("b")).alias("ratio"))


def correlation(a: DataFrame, b: DataFrame, log1p: bool = False, method: str = "pearson") -> DataFrame:
    """One row (n, r) over the cells of either matrix, within chromosomes, off the diagonal, with a sum above 1."""
    off = intra() & (F.col("bin1") != F.col("bin2"))
    x = a.where(off).withColumnRenamed("value", "x").join(b.where(off).withColumnRenamed("value", "y"), ["bin1", "bin2"], "full").select(F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y")).where("x + y > 1")
    if log1p:
        x = x.select(F.log1p("x").alias("x"), F.log1p("y").alias("y"))
    if method == "spearman":
        # equal pairs of values become one row with a weight, so a frequent value is joined once
        t = x.groupBy("x", "y").agg(F.count(F.lit(1)).alias("w"))
        for c in ("x", "y"):
            ranks = running_count(t.groupBy(c).agg(F.sum("w").alias("c")), c)
            t = t.join(ranks.select(c, (F.col("upto") - (F.col("c") - 1) / 2).alias("rank_" + c)), c)
        w, a, b = F.col("w"), F.col("rank_x"), F.col("rank_y")
        m = t.agg(F.sum("w").alias("n"), F.sum(w * a).alias("a"), F.sum(w * b).alias("b"), F.sum(w * a * a).alias("aa"), F.sum(w * b * b).alias("bb"), F.sum(w * a * b).alias("ab"))
        low = F.sqrt((F.col("aa") - F.col("a") ** 2 / F.col("n")) * (F.col("bb") - F.col("b") ** 2 / F.col("n")))
        return m.select(F.col("n").alias("n"), F.when(low > 0, (F.col("ab") - F.col("a") * F.col("b") / F.col("n")) / low).alias("r"))
    return x.agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("r"))


# -- pile-ups ----------------------------------------------------------------------------
def region_pairs(points: DataFrame, least: int, most: int, others: DataFrame | None = None) -> DataFrame:
    """Distinct bin pairs of one chromosome whose distance in bins lies in a range: (bin1, bin2), found by a band join."""
    a = points.select("bin_id").distinct()
    b = (others or points).select("bin_id").distinct()
    span = max(1, most)
    left = a.select(F.col("bin_id").alias("bin1"), F.explode(F.sequence(F.floor(F.col("bin_id") / span) - 1, F.floor(F.col("bin_id") / span) + 1)).alias("k"))
    right = b.select(F.col("bin_id").alias("bin2"), F.floor(F.col("bin_id") / span).alias("k"))
    x = left.join(right, "k").where(intra() & (dist() >= least) & (dist() <= most))
    return x.select(F.least("bin1", "bin2").alias("bin1"), F.greatest("bin1", "bin2").alias("bin2")).distinct()


def pile_up(pixels: DataFrame, pairs: DataFrame, bins: DataFrame, half: int, how: str = "mean", transform: str = "none") -> DataFrame:
    """(dr, dc, value): mean, sum or exact median over the windows that fit into the chromosome and are not all zero."""
    n = F.broadcast(bins_per_chrom(bins))
    fit = pairs.withColumn("chrom", chrom_of("bin1")).join(n, "chrom").where((offset_of("bin1") >= half) & (offset_of("bin2") + half < F.col("n")) & (offset_of("bin1") + half < F.col("n")) & (offset_of("bin2") >= half))
    w = window_cells(pixels, fit, half)
    total = w.groupBy("bin1", "bin2").agg(F.sum("value").alias("t")).where("t > 0")
    w = w.join(total, ["bin1", "bin2"])
    v = F.col("value") / F.col("t") if transform == "total-counts" else F.col("value")
    f = {"mean": F.avg, "sum": F.sum, "median": F.median}[how]
    return w.groupBy("dr", "dc").agg(f(v).alias("value"))


def rotated(window: DataFrame) -> DataFrame:
    return window.select((F.col("dr") + F.col("dc")).alias("along"), (F.col("dc") - F.col("dr")).alias("across"), "value")


# -- viewpoints --------------------------------------------------------------------------
def viewpoints(pixels: DataFrame, points: DataFrame, bins: DataFrame, reach: int) -> DataFrame:
    """(id, rel_pos, raw): row sums of a point's bin at all bins within ``reach`` of it in the chromosome, absent ones zero."""
    n = F.broadcast(bins_per_chrom(bins))
    p = points.select("id", "bin_id").distinct().withColumn("chrom", chrom_of("bin_id")).join(n, "chrom")
    at = F.sequence(F.greatest(-F.lit(reach), -offset_of("bin_id")), F.least(F.lit(reach).cast("bigint"), F.col("n") - 1 - offset_of("bin_id")))
    full = p.select("id", "bin_id", F.explode(at).alias("rel_pos")).withColumns({"bin1": F.least(F.col("bin_id"), F.col("bin_id") + F.col("rel_pos")), "bin2": F.greatest(F.col("bin_id"), F.col("bin_id") + F.col("rel_pos"))})
    return full.join(pixels, ["bin1", "bin2"], "left").select("id", "rel_pos", F.coalesce("value", F.lit(0.0)).alias("raw"))


def smooth(profile: DataFrame, window: int = 5) -> DataFrame:
    w = W.partitionBy("id").orderBy("rel_pos").rowsBetween(-(window // 2), window // 2)
    return profile.withColumn("smooth", F.avg("raw").over(w))


def relative(profile: DataFrame, fixate: int) -> DataFrame:
    """Adds ``relative``: share of the sum within ``fixate`` bins."""
    t = F.sum(F.when(F.abs("rel_pos") <= fixate, F.col("smooth"))).over(W.partitionBy("id"))
    return profile.withColumn("relative", F.when(t > 0, F.col("smooth") / t).otherwise(0.0))


def background(profile: DataFrame, truncate_zeros: bool = False) -> DataFrame:
    """(rel_pos, size, prob, most, mean): a negative binomial per relative position; equal counts are pooled before the fit."""
    x = profile.where("raw > 0") if truncate_zeros else profile
    c = x.groupBy("rel_pos", F.floor("raw").alias("v")).agg(F.count(F.lit(1)).alias("c"), F.sum("relative").alias("s"))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        size, prob = nb_fit(t["v"].to_numpy(), t["c"].to_numpy())
        return pd.DataFrame({"rel_pos": [t["rel_pos"].iloc[0]], "size": size, "prob": prob, "most": float(t["v"].max()), "mean": t["s"].sum() / t["c"].sum()})

    return c.groupBy("rel_pos").applyInPandas(run, "rel_pos bigint, size double, prob double, most double, mean double")


def point_quality(profile: DataFrame, share: float) -> DataFrame:
    """(id, sparsity, ok): share of positions with a contact."""
    s = profile.groupBy("id").agg((F.count_if(F.col("raw") > 0) / F.count(F.lit(1))).alias("sparsity"))
    return s.withColumn("ok", F.col("sparsity") > share)


def significant_runs(hits: DataFrame) -> DataFrame:
    """Neighbouring positions of a viewpoint become one: (id, start, end, rel_pos of the most raw, raw summed)."""
    w = W.partitionBy("id").orderBy("rel_pos")
    new = F.when(F.col("rel_pos") - F.lag("rel_pos").over(w) <= 1, 0).otherwise(1)
    g = hits.withColumn("_n", new).withColumn("g", F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return g.groupBy("id", "g").agg(
        F.min("rel_pos").alias("start"), F.max("rel_pos").alias("end"), F.max(F.struct("raw", (-F.col("rel_pos")).alias("n"))).alias("top"), F.sum("raw").alias("raw")
    ).select("id", "start", "end", (-F.col("top.n")).alias("rel_pos"), "raw")


def chi2(s1: Column, x1: Column, s2: Column, x2: Column) -> Column:
    """Statistic of ((s1, x1), (s2, x2)) without correction."""
    n = s1 + x1 + s2 + x2
    low = (s1 + x1) * (s2 + x2) * (s1 + s2) * (x1 + x2)
    return F.when(low > 0, n * (s1 * x2 - x1 * s2) * (s1 * x2 - x1 * s2) / low)


def differential(a: DataFrame, b: DataFrame, test: str = "fisher", alpha: float = 0.05) -> DataFrame:
    """Viewpoint positions of two samples: (id, rel_pos, stat or NULL, p, rejected)."""
    sums = lambda x, k: x.withColumn(f"s{k}", F.sum("raw").over(W.partitionBy("id"))).withColumnRenamed("raw", f"x{k}").select("id", "rel_pos", f"s{k}", f"x{k}")
    both = sums(a, 1).join(sums(b, 2), ["id", "rel_pos"])
    stat = chi2(F.col("s1"), F.col("x1"), F.col("s2"), F.col("x2"))
    p = p_of_chi2(stat) if test == "chi2" else fisher_p("s1", "x1", "s2", "x2")
    return both.withColumn("stat", stat if test == "chi2" else F.lit(None).cast("double")).withColumn("p", p).withColumn("rejected", F.coalesce(F.col("p") <= alpha, F.lit(False)))


def boundary_features(pixels: DataFrame, bins: DataFrame, half: int, fill: float = -1.0) -> DataFrame:
    """(bin_id, features): the upper triangle of the square around each bin, in order; border bins go."""
    n = F.broadcast(bins_per_chrom(bins))
    c = bins.join(n, "chrom").where((offset_of("bin_id") >= half) & (offset_of("bin_id") + half < F.col("n"))).select(F.col("bin_id").alias("bin1"), F.col("bin_id").alias("bin2"))
    w = window_cells(pixels, c, half).where("dr <= dc").withColumn("value", F.coalesce(F.nanvl("value", F.lit(fill)), F.lit(fill)))
    return w.groupBy(F.col("bin1").alias("bin_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("dr", "dc", "value"))), lambda s: s["value"]).alias("features"))


def train_boundaries(features: DataFrame, labels: DataFrame, seed: int = 7, trees: int = 20):
    """A forest of (bin_id, features) against (bin_id) of boundaries, the other class sampled down to their number; none without both classes."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    x = features.join(labels.select("bin_id").distinct().withColumn("label", F.lit(1.0)), "bin_id", "left").na.fill(0.0, ["label"])
    n = {r["label"]: r["n"] for r in x.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if len(n) < 2:
        return None
    x = x.sampleBy("label", {1.0: 1.0, 0.0: min(1.0, n.get(1.0, 0) / max(1, n.get(0.0, 0)))}, seed)
    return RandomForestClassifier(numTrees=trees, seed=seed, maxDepth=6).fit(x.withColumn("features", array_to_vector("features")))


def predict_boundaries(model, features: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    if model is None:
        return features.select("bin_id", F.lit(0).alias("boundary"))
    return model.transform(features.withColumn("features", array_to_vector("features"))).select("bin_id", F.col("prediction").cast("int").alias("boundary"))

