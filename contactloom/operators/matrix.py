"""Distance statistics, transforms, matrix algebra and bias correction over pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..frames import STRIDE, bins_per_chrom, chrom_of, cut, dist, intra, mirror, offset_of, small, spread, upper


# -- distances ---------------------------------------------------------------------------
def by_distance(pixels: DataFrame, bins: DataFrame) -> DataFrame:
    """(chrom, d, total, squares, stored, cells): sums over stored pixels, and how many cells the diagonal has."""
    px = pixels.where(intra()).groupBy(chrom_of("bin1").alias("chrom"), dist().alias("d")).agg(
        F.sum("value").alias("total"), F.sum(F.col("value") * F.col("value")).alias("squares"), F.count(F.lit(1)).alias("stored")
    )
    return px.join(F.broadcast(bins_per_chrom(bins)), "chrom").select("*", (F.col("n") - F.col("d")).alias("cells"))  # a row per chromosome


def expected(pixels: DataFrame, bins: DataFrame, method: str = "mean") -> DataFrame:
    """(d, expected) over the whole genome.

    'mean' divides by the cells of both triangles' rows as the reference counts them
    (n + 1 - d), 'non_zero' by stored cells, 'lieberman' by L - d * C.
    """
    e = pixels.where(intra()).groupBy(dist().alias("d")).agg(F.sum("value").alias("v"), F.count(F.lit(1)).alias("stored"))
    shape = bins.agg(F.count(F.lit(1)).alias("L"), F.countDistinct("chrom").alias("C"))
    e = e.crossJoin(F.broadcast(shape))  # one row
    below = {"mean": F.col("L") + 1 - F.col("d"), "non_zero": F.col("stored"), "lieberman": F.col("L") - F.col("d") * F.col("C")}[method]
    return e.select("d", F.when(below > 0, F.col("v") / below).otherwise(0.0).alias("expected"))


def obs_exp(pixels: DataFrame, bins: DataFrame, method: str = "mean", compat: bool = True, ligation: bool = False) -> DataFrame:
    """Values over what their distance lets expect; with ``compat`` the mean and lieberman forms look up ceil(d / 2)."""
    half = compat and method != "non_zero"
    key = F.ceil(dist() / 2).cast("bigint") if half else dist()
    out = pixels.where(intra()).withColumn("d", key).join(F.broadcast(expected(pixels, bins, method)), "d")  # a row per distance
    e = F.col("expected")
    if ligation:
        m = marginals(pixels)
        total = pixels.agg(F.sum("value").alias("all"))
        m = small(m)
        out = out.join(m.toDF("bin1", "m1"), "bin1").join(m.toDF("bin2", "m2"), "bin2").crossJoin(F.broadcast(total))
        e = e * F.col("m1") * F.col("m2") / F.col("all")
    return out.select("bin1", "bin2", F.when(e > 0, F.col("value") / e).otherwise(0.0).alias("value"))


def zscore(pixels: DataFrame, bins: DataFrame) -> DataFrame:
    """(v - mean) / deviation over all cells of a distance in the chromosome, absent ones as zero."""
    s = by_distance(pixels, bins).select("chrom", "d", (F.col("total") / F.col("cells")).alias("mu"), (F.col("squares") / F.col("cells")).alias("m2"))
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("m2") - F.col("mu") * F.col("mu")))
    px = pixels.where(intra()).withColumns({"chrom": chrom_of("bin1"), "d": dist()}).join(F.broadcast(s), ["chrom", "d"])
    return px.select("bin1", "bin2", F.when(sd > 1e-12, (F.col("value") - F.col("mu")) / sd).otherwise(0.0).alias("value"))


def decay(pixels: DataFrame, bins: DataFrame, max_bins: int, by_chrom: bool = False) -> DataFrame:
    """Mean per distance, cells being those possible or stored, whichever are more."""
    s = by_distance(pixels, bins).where(F.col("d") <= max_bins)
    keys = ["chrom", "d"] if by_chrom else ["d"]
    return s.groupBy(*keys).agg((F.sum("total") / F.sum(F.greatest("cells", "stored"))).alias("mean"))


def short_long(pixels: DataFrame, bins_far: int) -> DataFrame:
    s = pixels.where(intra()).groupBy(chrom_of("bin1").alias("chrom")).agg(F.sum(F.when(dist() <= bins_far, F.col("value")).otherwise(0)).alias("short"), F.sum(F.when(dist() > bins_far, F.col("value")).otherwise(0)).alias("long"))
    return s.where("long > 0").select("chrom", "short", "long", (F.col("short") / F.col("long")).alias("ratio"))


def marginals(pixels: DataFrame) -> DataFrame:
    return mirror(pixels).groupBy(F.col("bin1").alias("bin_id")).agg(F.sum("value").alias("total"))


TILE = 256


def tile_blocks(pixels: DataFrame, tile: int) -> DataFrame:
    """(chrom, i, k, cells): the cells of both triangles within chromosomes, packed by tiles of rows and columns."""
    kind = np.dtype([("r", "<u2"), ("c", "<u2"), ("v", "<f8")])
    at = lambda c: F.floor(offset_of(c) / tile).cast("int")
    m = mirror(pixels.where(intra())).select(chrom_of("bin1").alias("chrom"), at("bin1").alias("i"), at("bin2").alias("k"), (offset_of("bin1") % tile).alias("r"), (offset_of("bin2") % tile).alias("c"), "value")

    def pack(t: pa.Table) -> pa.Table:
        x = np.empty(t.num_rows, kind)
        x["r"], x["c"], x["v"] = (t.column(c).to_numpy() for c in ("r", "c", "value"))
        return t.select(["chrom", "i", "k"]).slice(0, 1).append_column("cells", pa.array([x.tobytes()], pa.binary()))

    return m.groupBy("chrom", "i", "k").applyInArrow(pack, "chrom bigint, i int, k int, cells binary")


def _tile_sums(batches, tile: int) -> tuple[np.ndarray, list]:
    """The sum of the products of a group's pairs of blocks, and its row without blocks, if there is one."""
    kind = np.dtype([("r", "<u2"), ("c", "<u2"), ("v", "<f8")])
    s, own = np.zeros((tile, tile)), []
    for b in batches:
        for one in b.to_pylist():
            if one["left"] is None:
                own.append(one)
                continue
            x, y = np.frombuffer(one["left"], kind), np.frombuffer(one["right"], kind)
            both = np.intersect1d(x["c"], y["c"])
            for lo in range(0, len(both), 256):
                part = both[lo : lo + 256]
                sides = []
                for z in (x, y):
                    z = z[np.isin(z["c"], part)]
                    a = np.zeros((tile, len(part)))
                    a[z["r"], np.searchsorted(part, z["c"])] = z["v"]
                    sides.append(a)
                s += sides[0] @ sides[1].T
    return s, own


def _block_pairs(pixels: DataFrame, tile: int) -> DataFrame:
    """(chrom, i, j, left, right): blocks of rows i and j, i <= j, that have the same tile of columns; those that share none do not meet."""
    b = tile_blocks(pixels, tile)
    left, right = b.select("chrom", "i", "k", F.col("cells").alias("left")), b.select("chrom", F.col("i").alias("j"), "k", F.col("cells").alias("right"))
    return left.join(right, ["chrom", "k"]).where("i <= j").select("chrom", "i", "j", "left", "right")


def row_products(pixels: DataFrame, bins: DataFrame, tile: int = TILE) -> DataFrame:
    """(bin1, bin2, s) with s(k, l) = sum v_ki v_li, zeros left out: a blocked product, whatever the degree of a bin."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, i, j = (x.as_py() for x in key)
        s, _ = _tile_sums(batches, tile)
        x, y = np.nonzero(s)
        bin1, bin2 = c * STRIDE + i * tile + x, c * STRIDE + j * tile + y
        ok = bin1 <= bin2
        yield pa.RecordBatch.from_arrays([pa.array(bin1[ok]), pa.array(bin2[ok]), pa.array(s[x, y][ok])], ["bin1", "bin2", "s"])

    return _block_pairs(pixels, tile).groupBy("chrom", "i", "j").applyInArrow(run, "bin1 bigint, bin2 bigint, s double")


def covariance(pixels: DataFrame, bins: DataFrame, pearson: bool = False, tile: int = 1024) -> DataFrame:
    """Row-row covariance (n - 1) or correlation of all bin pairs within chromosomes, absent cells as zero; a correlation with a constant row is 0.

    The result is dense, as its definition is: bins of a chromosome squared over two rows. A task makes a square
    of ``tile`` bins from the packed cells of its rows and gives it row by row; no dense cell is shuffled.
    """
    n = bins_per_chrom(bins)
    sizes = [r["n"] for r in n.collect()]  # a row per chromosome
    r = mirror(pixels.where(intra())).groupBy(F.col("bin1").alias("bin_id")).agg(F.sum("value").alias("t"), F.sum(F.col("value") * F.col("value")).alias("q"))
    every = bins.select("bin_id", "chrom").join(r, "bin_id", "left").na.fill(0.0, ["t", "q"])
    rows = F.array_sort(F.collect_list(F.struct("bin_id", "t", "q")))  # of at most a tile
    stats = every.groupBy("chrom", F.floor(offset_of("bin_id") / tile).cast("int").alias("i")).agg(rows.alias("x")).select("chrom", "i", *[F.col(f"x.{c}").alias(c) for c in ("t", "q")])
    both = stats.toDF("chrom", "i", "t1", "q1").join(small(stats.toDF("chrom", "j", "t2", "q2"), 2000), "chrom").where("i <= j").join(F.broadcast(n), "chrom")
    grid = both.select("chrom", "i", "j", F.lit(None).cast("binary").alias("left"), F.lit(None).cast("binary").alias("right"), "n", "t1", "q1", "t2", "q2")
    cells = _block_pairs(pixels, tile).select("*", F.lit(None).cast("bigint").alias("n"), *[F.lit(None).cast("array<double>").alias(c) for c in ("t1", "q1", "t2", "q2")])

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, i, j = (x.as_py() for x in key)
        s, own = _tile_sums(batches, tile)
        if not own:  # cells beyond the bins
            return
        n, t1, q1, t2, q2 = (np.array(own[0][x], float) for x in ("n", "t1", "q1", "t2", "q2"))
        s = s[: len(t1), : len(t2)] - t1[:, None] * t2 / n
        if pearson:
            low = np.sqrt(np.maximum(0.0, q1 - t1**2 / n)[:, None] * np.maximum(0.0, q2 - t2**2 / n))
            s = np.divide(s, low, out=np.zeros(s.shape), where=low > 1e-9)
        elif n > 1:
            s = s / (n - 1)
        for lo in range(0, len(t1), 128):
            some = np.arange(lo, min(lo + 128, len(t1)))
            first = np.where(i == j, some, 0)
            values = [s[x, f:] if pearson or n > 1 else np.full(len(t2) - f, None) for x, f in zip(some, first, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c * STRIDE + i * tile + some), pa.array(c * STRIDE + j * tile + first), pa.array(values, pa.list_(pa.float64()))], ["bin1", "first", "values"])

    tiles = sum((k := -(-m // tile)) * (k + 1) // 2 for m in sizes)
    x = grid.union(cells).repartition(max(1, min(tiles, 20_000)), "chrom", "i", "j").groupBy("chrom", "i", "j").applyInArrow(run, "bin1 bigint, first bigint, values array<double>")
    return x.select("bin1", "first", F.posexplode("values").alias("k", "value")).select("bin1", (F.col("first") + F.col("k")).alias("bin2"), "value")


def info(pixels: DataFrame, bins: DataFrame) -> DataFrame:
    p = pixels.agg(
        F.count(F.lit(1)).alias("nnz"), F.min("value").alias("least"), F.max("value").alias("most"), F.sum("value").alias("total"),
        F.sum(F.when(F.col("bin1") == F.col("bin2"), F.col("value")).otherwise(0)).alias("diagonal"),
    )
    b = bins.agg(F.count(F.lit(1)).alias("size"), F.median(F.col("end") - F.col("start")).cast("bigint").alias("bin_length"), F.countDistinct("chrom").alias("chroms"))
    return p.crossJoin(b)


# -- normalisation -----------------------------------------------------------------------
def normalize_range(pixels: DataFrame, threshold: float = 0.0) -> DataFrame:
    r = pixels.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    v = (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    return pixels.crossJoin(F.broadcast(r)).select("bin1", "bin2", v.alias("value")).where(F.col("value") >= threshold)


def normalize_smallest(samples: DataFrame) -> DataFrame:
    """Pixels of several samples scaled to the smallest total: (sample, bin1, bin2, value)."""
    t = samples.groupBy("sample").agg(F.sum("value").alias("t"))
    t = t.crossJoin(t.agg(F.min("t").alias("least")))  # one row
    return samples.join(F.broadcast(t), "sample").select("sample", "bin1", "bin2", (F.col("value") * F.col("least") / F.col("t")).alias("value"))


def multiply(pixels: DataFrame, factor: float, threshold: float = 0.0) -> DataFrame:
    return pixels.select("bin1", "bin2", (F.col("value") * factor).alias("value")).where(F.col("value") >= threshold)


def clean(value: Column, to: float = 0.0) -> Column:
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), to).otherwise(value)


# -- algebra -----------------------------------------------------------------------------
def add(*matrices: DataFrame) -> DataFrame:
    out = matrices[0]
    for m in matrices[1:]:
        out = out.unionByName(m)
    return out.groupBy("bin1", "bin2").agg(F.sum("value").alias("value"))


def compare(a: DataFrame, b: DataFrame, how: str = "log2ratio", norm: bool = True) -> DataFrame:
    """'diff' over cells of either, 'ratio' and 'log2ratio' over cells of both; zeros of the logarithm go."""
    def scaled(x: DataFrame, name: str) -> DataFrame:
        v = F.col("value") / F.col("t") if norm else F.col("value")
        return x.crossJoin(F.broadcast(x.agg(F.sum("value").alias("t")))).select("bin1", "bin2", v.alias(name))

    both = scaled(a, "x").join(scaled(b, "y"), ["bin1", "bin2"], "full" if how == "diff" else "inner")
    if how == "diff":
        return both.select("bin1", "bin2", (F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0))).alias("value"))
    r = F.col("x") / F.col("y")
    out = both.where("y <> 0").select("bin1", "bin2", (F.log2(r) if how == "log2ratio" else r).alias("value"))
    return out.where("value <> 0") if how == "log2ratio" else out


def coarsen_map(bins: DataFrame, k: int) -> DataFrame:
    """(bin_id, group, start, end): k bins of a chromosome each; a rest below k / 2 goes unless it ends the genome."""
    w = W.partitionBy("chrom").orderBy("bin_id")
    g = bins.select("bin_id", "chrom", "start", "end", F.floor((F.row_number().over(w) - 1) / k).alias("g"))
    per = g.groupBy("chrom", "g").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("s"), F.max("end").alias("e"))
    last = bins.agg(F.max("chrom").alias("last"))
    top = W.partitionBy("chrom")
    per = per.crossJoin(F.broadcast(last)).withColumn("z", F.max("g").over(top))
    kept = per.where((F.col("n") >= k / 2) | ((F.col("chrom") == F.col("last")) & (F.col("g") == F.col("z"))))
    return g.select("bin_id", "chrom", "g").join(kept.select("chrom", "g", "s", "e"), ["chrom", "g"]).select("bin_id", (F.col("chrom") * STRIDE + F.col("g")).alias("group"), F.col("s").alias("start"), F.col("e").alias("end"))


def reduce(pixels: DataFrame, groups: DataFrame) -> DataFrame:
    """Sums pixels by (bin_id, group); bins without a group go."""
    g = small(groups.select("bin_id", "group"))
    x = pixels.join(g.toDF("bin1", "g1"), "bin1").join(g.toDF("bin2", "g2"), "bin2")
    return upper(x.select(F.col("g1").alias("bin1"), F.col("g2").alias("bin2"), "value"))


def running_window(pixels: DataFrame, bins: DataFrame, odd: int) -> DataFrame:
    """Adds each upper cell to the cells of an ``odd`` square around it; what leaves the upper triangle or the genome goes.

    Pixels are dealt to the tiles that their square touches, mostly one, and spread within a tile: the shuffle
    has the pixels, not ``odd`` squared times as many cells.
    """
    h = odd // 2
    tiles = lambda c: F.explode(F.sequence(F.floor((F.col(c) - h) / TILE), F.floor((F.col(c) + h) / TILE)))
    x = spread(pixels.select("bin1", "bin2", "value", tiles("bin1").alias("i")).withColumn("j", tiles("bin2")), "i", "j", times=odd * odd)
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-h, h + 1) for j in range(-h, h + 1)])
    x = x.select("i", "j", "bin1", "bin2", "value", F.explode(around).alias("o")).select("i", "j", (F.col("bin1") + F.col("o.i")).alias("bin1"), (F.col("bin2") + F.col("o.j")).alias("bin2"), "value")
    x = x.where((F.floor(F.col("bin1") / TILE) == F.col("i")) & (F.floor(F.col("bin2") / TILE) == F.col("j")))
    x = x.where("bin1 <= bin2").groupBy("i", "j", "bin1", "bin2").agg(F.sum("value").alias("value"))
    b = small(bins.select("bin_id"))
    return x.join(b.toDF("bin1"), "bin1", "left_semi").join(b.toDF("bin2"), "bin2", "left_semi").select("bin1", "bin2", "value")


def domain_groups(bins: DataFrame, domains: DataFrame) -> DataFrame:
    """(bin_id, group): bins between two boundaries become one."""
    edges = domains.select("chrom", "start").union(domains.select("chrom", "end")).distinct().withColumn("edge", F.lit(1))
    w = W.partitionBy("chrom").orderBy("start")
    g = bins.join(F.broadcast(edges) if edges.limit(200_001).count() <= 200_000 else edges, ["chrom", "start"], "left")
    return g.select("bin_id", (F.col("chrom") * STRIDE + F.sum(F.coalesce("edge", F.lit(0))).over(w)).alias("group"))


def keep_bins(pixels: DataFrame, bins: DataFrame, how: str = "left_semi") -> DataFrame:
    """Pixels whose two bins are among ``bins`` ('left_semi') or none of them ('left_anti')."""
    b = small(bins.select("bin_id"))
    return pixels.join(b.toDF("bin1"), "bin1", how).join(b.toDF("bin2"), "bin2", how).select("bin1", "bin2", "value")


def trans_cutoff(pixels: DataFrame, share: float) -> DataFrame:
    """Values between chromosomes above their exact (1 - share) quantile are set to it."""
    q = pixels.where(~intra()).agg(F.percentile("value", F.lit(1 - share)).alias("q"))
    return pixels.crossJoin(F.broadcast(q)).select("bin1", "bin2", F.when(~intra(), F.least("value", "q")).otherwise(F.col("value")).alias("value"))


# -- balancing ---------------------------------------------------------------------------
def mad_scores(pixels: DataFrame) -> DataFrame:
    """(bin_id, total, z): 0.6745 * (x - median of x > 0) / median of deviations of all."""
    diag = pixels.where("bin1 <> bin2")
    x = marginals(diag)
    med = x.agg(F.median(F.when(F.col("total") > 0, F.col("total"))).alias("med"))
    x = x.crossJoin(F.broadcast(med))
    mad = x.agg(F.median(F.abs(F.col("total") - F.col("med"))).alias("mad"))
    return x.crossJoin(F.broadcast(mad)).select("bin_id", "total", F.when(F.col("mad") > 0, 0.6745 * (F.col("total") - F.col("med")) / F.col("mad")).otherwise(0.0).alias("z"))


def apply_bias(pixels: DataFrame, bias: DataFrame) -> DataFrame:
    b = small(bias.select("bin_id", "bias"))
    return pixels.join(b.toDF("bin1", "x"), "bin1").join(b.toDF("bin2", "y"), "bin2").select("bin1", "bin2", (F.col("value") / (F.col("x") * F.col("y"))).alias("value"))


ROWS = 128


def packed_rows(pixels: DataFrame) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """(bins, sums, blocks): the bins with a positive row sum in order, their sums, and both triangles as packed blocks of rows over them.

    A block holds at most ``ROWS`` rows: their places in ``bins``, where each begins, and the places
    and values of its cells, as the bytes of arrays. Blocks are cut to the shared folder, so pixels
    are made once, whatever is done with them after. The driver holds vectors: a number a bin.
    """
    sums = marginals(pixels).where("total > 0").toArrow().sort_by("bin_id")
    ids = sums.column("bin_id").to_numpy()

    def place(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(ids, b), len(ids) - 1)
        return at, ids[at] == b

    def run(t: pa.Table) -> pa.Table:
        rows, known = place(t.column("bin1").to_numpy())
        cols, also = place(t.column("bin2").to_numpy())
        ok = np.flatnonzero(known & also)
        ok = ok[np.argsort(rows[ok], kind="stable")]
        row, first = np.unique(rows[ok], return_index=True)
        parts = (row.astype(np.int32), first.astype(np.int32), cols[ok].astype(np.int32), t.column("value").to_numpy()[ok])
        return pa.table({n: pa.array([x.tobytes()], pa.binary()) for n, x in zip(("rows", "starts", "cols", "vals"), parts, strict=True)})

    m = mirror(pixels) if len(ids) else mirror(pixels).limit(0)
    blocks = m.groupBy(F.floor(F.col("bin1") / ROWS).alias("_b")).applyInArrow(run, "rows binary, starts binary, cols binary, vals binary")
    return ids, sums.column("total").to_numpy(), cut(blocks)


def rows_times(blocks: DataFrame, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A v, which rows have cells) of packed rows: one pass that gives a number a row."""

    def run(batches):
        for b in batches:
            rows, sums = [], []
            for r, s, c, x in zip(*(b.column(k) for k in range(4)), strict=True):
                r, s, c = (np.frombuffer(y.as_buffer(), np.int32) for y in (r, s, c))
                if len(r):
                    rows.append(r)
                    sums.append(np.add.reduceat(np.frombuffer(x.as_buffer(), np.float64) * v[c], s))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(np.concatenate(sums))], ["place", "s"])

    t = blocks.mapInArrow(run, "place int, s double").toArrow()
    out, seen = np.zeros(len(v)), np.zeros(len(v), bool)
    at = t.column("place").to_numpy()
    out[at], seen[at] = t.column("s").to_numpy(), True
    return out, seen


def _vector(spark, ids: np.ndarray, bias: np.ndarray) -> DataFrame:
    return spark.createDataFrame(pa.table({"bin_id": pa.array(ids, pa.int64()), "bias": pa.array(bias, pa.float64())}))


def ice(pixels: DataFrame, rounds: int = 50, tolerance: float = 1e-5, per_chrom: bool = False) -> DataFrame:
    """(bin_id, bias): iterative correction that keeps only the bias vector between rounds.

    Each round is one pass over packed rows that gives a sum a bin; the pixels are made
    and packed once.
    """
    ids, _, blocks = packed_rows(pixels.where(intra()) if per_chrom else pixels)
    _, unit = np.unique(ids // STRIDE if per_chrom else np.zeros(len(ids)), return_inverse=True)
    per = lambda x, w: np.bincount(unit, x * w) / np.bincount(unit, w)  # noqa: E731  mean over the rows w
    bias = np.ones(len(ids))
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(rounds if len(ids) else 0):
            total, seen = rows_times(blocks, 1 / bias)
            total = total / bias
            mean = per(total, (seen & (total > 0)).astype(float))[unit]
            s = np.where(seen & (mean > 0), total / mean, 1.0)
            bias = bias * s
            if np.abs(s - 1).max() < tolerance:
                break
        bias = bias / per(bias, np.ones(len(ids)))[unit] if len(ids) else bias
    return _vector(pixels.sparkSession, ids, bias)


def balance(pixels: DataFrame, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(bin_id, bias) with all row sums of v / (b_i b_j) equal to 1: the fixed point of b <- sqrt(b * (A / b)), found without a Newton step."""
    ids, sums, blocks = packed_rows(pixels)
    bias, kept = np.sqrt(sums), np.ones(len(ids), bool)
    for _ in range(rounds if len(ids) else 0):
        total, kept = rows_times(blocks, 1 / bias)
        total = np.where(kept, total / bias, 1.0)
        bias = bias * np.sqrt(total)
        if np.abs(total - 1).max() < tolerance:
            break
    return _vector(pixels.sparkSession, ids[kept], bias[kept])


def converted(pixels: DataFrame, weights: DataFrame, divide: bool = False, integers: bool = False, chrom: int | None = None) -> DataFrame:
    """Pixels with the correction of (bin_id, weight) applied by product or division, whole numbers or one chromosome if asked for."""
    px = pixels if chrom is None else pixels.where((chrom_of("bin1") == chrom) & (chrom_of("bin2") == chrom))
    w = small(weights.select("bin_id", "weight"))
    x = px.join(w.toDF("bin1", "x"), "bin1").join(w.toDF("bin2", "y"), "bin2")
    both = F.col("x") * F.col("y")
    v = F.col("value") / both if divide else F.col("value") * both
    return x.select("bin1", "bin2", (F.round(v) if integers else v).alias("value"))
