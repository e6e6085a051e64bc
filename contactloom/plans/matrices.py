"""Queries over pixels: distances, transforms, algebra and balancing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..frames import cut, intra, rounded, spread
from ..operators import matrix as M
from ..registry import register
from ..sources import tables as T
from .base import BINS, PX, sql


def _r(df, *columns, digits=6):
    return df.withColumns({c: rounded(c, digits) for c in columns or ("value",)})


def _inputs(spark, d):
    return T.pixels(spark, d), T.fixed_bins(spark, d)


_SHAPE = "SELECT count(*) AS L, count(DISTINCT chrom) AS C FROM bins"
for _name, _low in (("mean", "L + 1 - d"), ("non_zero", "stored"), ("lieberman", "L - d * C")):
    _exp = f"SELECT d, CASE WHEN {_low} > 0 THEN v / ({_low}) ELSE 0 END AS expected FROM (SELECT d, sum(value) AS v, count(*) AS stored FROM intra GROUP BY 1), shape"

    @register(f"expected_{_name}", sql("SELECT d, round(expected, 6) AS expected FROM e", *PX, "intra", *BINS, shape=_SHAPE, e=_exp))
    def _expected(spark, d, how=_name):
        return _r(M.expected(*_inputs(spark, d), how), "expected")

    _key = "d" if _name == "non_zero" else "(d + 1) // 2"

    @register(f"obs_exp_{_name}", sql(f"SELECT bin1, bin2, round(CASE WHEN expected > 0 THEN value / expected ELSE 0 END, 6) AS value FROM intra i JOIN e ON e.d = {_key.replace('d', 'i.d')}", *PX, "intra", *BINS, shape=_SHAPE, e=_exp))
    def _obs_exp(spark, d, how=_name):
        return _r(M.obs_exp(*_inputs(spark, d), how))


@register("obs_exp_ligation", sql("SELECT i.bin1, i.bin2, round(value / (expected * a.t * b.t / (SELECT sum(value) FROM px)), 6) AS value FROM intra i JOIN e USING (d) JOIN m a ON a.b = bin1 JOIN m b ON b.b = bin2", *PX, "intra", "full_px", e="SELECT d, sum(value) / count(*) AS expected FROM intra GROUP BY 1", m="SELECT bin1 AS b, sum(value) AS t FROM full_px GROUP BY 1"))
def ligation(spark, d):
    return _r(M.obs_exp(*_inputs(spark, d), "non_zero", ligation=True))


_STATS = "SELECT chrom, d, sum(value) / (n - d) AS mu, sum(value * value) / (n - d) AS m2 FROM intra JOIN perchrom USING (chrom) GROUP BY chrom, d, n"
_Z = "SELECT bin1, bin2, CASE WHEN sqrt(greatest(0, m2 - mu * mu)) > 1e-12 THEN (value - mu) / sqrt(greatest(0, m2 - mu * mu)) ELSE 0 END AS value FROM intra JOIN s USING (chrom, d)"


@register("zscore", sql(f"SELECT bin1, bin2, round(value, 6) AS value FROM ({_Z})", *PX, "intra", *BINS, s=_STATS))
def zscore(spark, d):
    return _r(M.zscore(*_inputs(spark, d)))


@register("distance_decay", sql("SELECT chrom, d, round(sum(value) / greatest(n - d, count(*)), 6) AS mean FROM intra JOIN perchrom USING (chrom) WHERE d <= 30 GROUP BY chrom, d, n", *PX, "intra", *BINS))
def decay(spark, d):
    return _r(M.decay(*_inputs(spark, d), 30, by_chrom=True), "mean")


@register("short_long_ratio", sql("SELECT chrom, sum(value) FILTER (d <= 10) AS short, sum(value) FILTER (d > 10) AS long, round(sum(value) FILTER (d <= 10) / sum(value) FILTER (d > 10), 6) AS ratio FROM intra GROUP BY 1 HAVING sum(value) FILTER (d > 10) > 0", *PX, "intra"))
def short_long(spark, d):
    return _r(M.short_long(T.pixels(spark, d), 10), "ratio")


@register("row_marginals", sql("SELECT bin1 AS bin_id, sum(value) AS total FROM full_px GROUP BY 1", *PX, "full_px"))
def marginals(spark, d):
    return M.marginals(T.pixels(spark, d))


_CELLS = "SELECT x.bin_id AS bin1, y.bin_id AS bin2, k.bin_id AS k, x.chrom, n FROM bins x JOIN bins y ON x.chrom = y.chrom AND x.bin_id <= y.bin_id JOIN bins k ON k.chrom = x.chrom JOIN perchrom ON perchrom.chrom = x.chrom"
_DENSE = "SELECT bin1, bin2, n, sum(a * b) AS s, sum(a) AS t1, sum(b) AS t2, sum(a * a) AS q1, sum(b * b) AS q2 FROM (SELECT c.*, coalesce(u.value, 0) AS a, coalesce(v.value, 0) AS b FROM cells c LEFT JOIN f u ON u.bin1 = c.bin1 AND u.bin2 = k LEFT JOIN f v ON v.bin1 = c.bin2 AND v.bin2 = k) GROUP BY ALL"
_F = "SELECT * FROM full_px WHERE bin1 // 1000000 = bin2 // 1000000"
for _name, _v in (("covariance", "CASE WHEN n > 1 THEN (s - t1 * t2 / n) / (n - 1) END"), ("pearson", "CASE WHEN sqrt(greatest(0, q1 - t1 * t1 / n) * greatest(0, q2 - t2 * t2 / n)) > 1e-9 THEN (s - t1 * t2 / n) / sqrt((q1 - t1 * t1 / n) * (q2 - t2 * t2 / n)) ELSE 0 END")):

    @register(f"matrix_{_name}", sql(f"SELECT bin1, bin2, round({_v}, 6) AS value FROM p", *PX, "full_px", *BINS, f=_F, cells=_CELLS, p=_DENSE))
    def _rows(spark, d, pearson=_name == "pearson"):
        return _r(M.covariance(*_inputs(spark, d), pearson))


@register("matrix_info", sql("""SELECT * FROM (SELECT count(*) AS nnz, min(value) AS least, max(value) AS most, sum(value) AS total, sum(CASE WHEN bin1 = bin2 THEN value ELSE 0 END) AS diagonal FROM px), (SELECT count(*) AS size, median("end" - start)::BIGINT AS bin_length, count(DISTINCT chrom) AS chroms FROM bins)""", *PX, *BINS))
def info(spark, d):
    return M.info(*_inputs(spark, d))


@register("normalize_range", sql("SELECT bin1, bin2, round((value - lo) / (hi - lo), 6) AS value FROM px, (SELECT min(value) AS lo, max(value) AS hi FROM px) WHERE (value - lo) / (hi - lo) >= 0.1", *PX))
def normalize_range(spark, d):
    return _r(M.normalize_range(T.pixels(spark, d), 0.1))


def _samples(spark, d):
    from ..operators.pairs import contact_matrix

    return contact_matrix(T.pairs(spark, d), T.BIN, ("sample",))


@register("normalize_smallest", sql("SELECT sample, bin1, bin2, round(value * (SELECT min(t) FROM t) / t, 6) AS value FROM pxs JOIN t USING (sample)", "mates", "pairs", "pxs", t="SELECT sample, sum(value) AS t FROM pxs GROUP BY 1"))
def normalize_smallest(spark, d):
    return _r(M.normalize_smallest(_samples(spark, d)))


@register("normalize_multiply", sql("SELECT bin1, bin2, value * 2.5 AS value FROM px WHERE value * 2.5 >= 5", *PX))
def normalize_multiply(spark, d):
    return M.multiply(T.pixels(spark, d), 2.5, 5.0)


@register("coverage_histogram", sql("SELECT CASE WHEN b > 100 THEN 100 ELSE b END AS bucket, count(*) AS n FROM (SELECT floor((t - lo) / (hi - lo) * 100)::BIGINT + 1 AS b FROM m, (SELECT min(t) AS lo, max(t) AS hi FROM m)) GROUP BY 1", *PX, "full_px", m="SELECT bin1, sum(value) AS t FROM full_px WHERE bin1 <> bin2 GROUP BY 1"))
def histogram(spark, d):
    m = M.marginals(T.pixels(spark, d).where("bin1 <> bin2"))
    x = m.crossJoin(F.broadcast(m.agg(F.min("total").alias("lo"), F.max("total").alias("hi"))))
    return x.groupBy(F.least(F.floor((F.col("total") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 100) + 1, F.lit(100)).cast("bigint").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def _two(spark, d):
    # one aggregation per sample; the filter reaches the mates' scan through the pair join's key
    return T.pixels(spark, d, sample=0), T.pixels(spark, d, sample=1)


@register("sum_matrices", sql("SELECT bin1, bin2, sum(value) AS value FROM pxs GROUP BY ALL", "mates", "pairs", "pxs"))
def sum_matrices(spark, d):
    return M.add(*_two(spark, d))


_N = "SELECT sample, bin1, bin2, value / sum(value) OVER (PARTITION BY sample) AS v FROM pxs"
for _name, _v in (("ratio", "x.v / y.v"), ("log2ratio", "log2(x.v / y.v)"), ("diff", "coalesce(x.v, 0) - coalesce(y.v, 0)")):
    _on = "FULL" if _name == "diff" else ""

    @register(f"compare_{_name}", sql(f"SELECT bin1, bin2, round({_v}, 9) AS value FROM (SELECT * FROM n WHERE sample = 0) x {_on} JOIN (SELECT * FROM n WHERE sample = 1) y USING (bin1, bin2)" + (f" WHERE {_v} <> 0" if _name == "log2ratio" else ""), "mates", "pairs", "pxs", n=_N))
    def _compare(spark, d, how=_name):
        return _r(M.compare(*_two(spark, d), how), digits=9)


_GROUPS = """SELECT bin_id, chrom * 1000000 + g AS grp FROM (SELECT bin_id, chrom, (row_number() OVER (PARTITION BY chrom ORDER BY bin_id) - 1) // 3 AS g FROM bins) JOIN (SELECT chrom, g FROM (SELECT chrom, g, count(*) AS n, max(g) OVER (PARTITION BY chrom) AS z FROM
 (SELECT chrom, (row_number() OVER (PARTITION BY chrom ORDER BY bin_id) - 1) // 3 AS g FROM bins) GROUP BY 1, 2) WHERE n >= 1.5 OR (chrom = (SELECT max(chrom) FROM bins) AND g = z)) USING (chrom, g)"""
_REDUCE = "SELECT least(a.grp, b.grp) AS bin1, greatest(a.grp, b.grp) AS bin2, sum(value) AS value FROM px JOIN g a ON a.bin_id = bin1 JOIN g b ON b.bin_id = bin2 GROUP BY ALL"


@register("merge_bins", sql(_REDUCE, *PX, *BINS, g=_GROUPS))
def merge_bins(spark, d):
    px, bins = _inputs(spark, d)
    return M.reduce(px, M.coarsen_map(bins, 3))


@register("merge_domain_bins", sql(_REDUCE, *PX, *BINS, "doms", g="""SELECT bin_id, (chrom * 1000000 + sum(CASE WHEN e THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start))::BIGINT AS grp FROM (SELECT b.*, EXISTS (SELECT 1 FROM doms d WHERE d.chrom = b.chrom AND (d.start = b.start OR d."end" = b.start)) AS e FROM bins b)"""))
def merge_domain_bins(spark, d):
    px, bins = _inputs(spark, d)
    return M.reduce(px, M.domain_groups(bins, T.domains(spark, d)))


@register("running_window", sql("SELECT x AS bin1, y AS bin2, sum(value) AS value FROM (SELECT bin1 + i AS x, bin2 + j AS y, value FROM px, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j)) WHERE x <= y AND x IN (SELECT bin_id FROM bins) AND y IN (SELECT bin_id FROM bins) GROUP BY ALL", *PX, *BINS))
def running_window(spark, d):
    return M.running_window(*_inputs(spark, d), 3)


@register("adjust_keep", sql("SELECT bin1, bin2, value FROM px WHERE bin1 // 1000000 IN (1, 3) AND bin2 // 1000000 IN (1, 3)", *PX))
def adjust_keep(spark, d):
    px, bins = _inputs(spark, d)
    return M.keep_bins(px, bins.where("chrom IN (1, 3)"))


@register("adjust_mask", sql("SELECT bin1, bin2, value FROM px WHERE NOT bin1 IN (SELECT bin_id FROM bins WHERE chrom = 2 AND start < 150000 AND \"end\" > 50000) AND NOT bin2 IN (SELECT bin_id FROM bins WHERE chrom = 2 AND start < 150000 AND \"end\" > 50000)", *PX, *BINS))
def adjust_mask(spark, d):
    px, bins = _inputs(spark, d)
    return M.keep_bins(px, bins.where("chrom = 2 AND start < 150000 AND end > 50000"), "left_anti")


@register("adjust_intra", sql("SELECT bin1, bin2, value FROM intra", *PX, "intra"))
def adjust_intra(spark, d):
    return T.pixels(spark, d).where(intra())


@register("trans_cutoff", sql("SELECT bin1, bin2, CASE WHEN bin1 // 1000000 <> bin2 // 1000000 THEN least(value, q) ELSE value END AS value FROM px, (SELECT quantile_cont(value, 0.95) AS q FROM px WHERE bin1 // 1000000 <> bin2 // 1000000)", *PX))
def trans_cutoff(spark, d):
    return M.trans_cutoff(T.pixels(spark, d), 0.05)


_MAD = "SELECT bin1 AS bin_id, sum(value) AS total FROM full_px WHERE bin1 <> bin2 GROUP BY 1"


@register("mad_scores", sql("SELECT bin_id, total, round(0.6745 * (total - med) / (SELECT median(abs(total - med)) FROM m, k), 6) AS z FROM m, k", *PX, "full_px", m=_MAD, k="SELECT median(total) FILTER (total > 0) AS med FROM m"))
def mad_scores(spark, d):
    return _r(M.mad_scores(T.pixels(spark, d)), "z")


@register("ice_bias")
def ice_bias(spark, d):
    """No SQL: rounds until no row sum is off the mean by the tolerance; the bound is that of the reference's command line."""
    return _r(M.ice(T.pixels(spark, d), rounds=500), "bias")


@register("ice_fixed_point", sql("SELECT DISTINCT bin1 AS bin_id, 1.0::DOUBLE AS s FROM full_px", *PX, "full_px"))
def ice_fixed_point(spark, d):
    """Row sums of the corrected matrix over their mean: 1 in every bin."""
    px = T.pixels(spark, d)
    m = cut(M.marginals(M.apply_bias(px, M.ice(px, rounds=500))).where("total > 0"))
    mean = m.agg(F.avg("total").alias("mean"))
    return m.crossJoin(F.broadcast(mean)).select("bin_id", rounded(F.col("total") / F.col("mean"), 4).alias("s"))


@register("ice_per_chromosome", sql("SELECT DISTINCT bin1 AS bin_id, 1.0::DOUBLE AS s FROM full_px WHERE bin1 // 1000000 = bin2 // 1000000", *PX, "full_px"))
def ice_per_chromosome(spark, d):
    """Blocks corrected apart: row sums within chromosomes over the mean of their chromosome."""
    px = T.pixels(spark, d).where(intra())
    m = cut(M.marginals(M.apply_bias(px, M.ice(px, rounds=500, per_chrom=True))).where("total > 0").withColumn("chrom", F.floor(F.col("bin_id") / 1_000_000)))
    mean = m.groupBy("chrom").agg(F.avg("total").alias("mean"))
    return m.join(F.broadcast(mean), "chrom").select("bin_id", rounded(F.col("total") / F.col("mean"), 4).alias("s"))  # a row per chromosome


@register("balance_fixed_point", sql("SELECT DISTINCT bin1 AS bin_id, 1.0::DOUBLE AS s FROM full_px", *PX, "full_px"))
def balance_fixed_point(spark, d):
    """Row sums of the balanced matrix: 1 in every bin."""
    px = T.pixels(spark, d)
    return M.marginals(M.apply_bias(px, M.balance(px))).select("bin_id", rounded("total", 4).alias("s"))


@register("balanced_matrix")
def balanced(spark, d):
    """No SQL: rounds until the row sums are 1."""
    px = T.pixels(spark, d)
    return M.apply_bias(px, M.balance(px))


@register("inflation", sql("SELECT a.b AS bin_id, round(t2 / t1, 6) AS ratio FROM (SELECT bin1 AS b, sum(value) AS t1 FROM full_px GROUP BY 1) a JOIN (SELECT bin1 AS b, sum(least(value, 5)) AS t2 FROM full_px GROUP BY 1) c USING (b)", *PX, "full_px"))
def inflation(spark, d):
    px = T.pixels(spark, d)
    after = M.marginals(px.withColumn("value", F.least("value", F.lit(5.0))))
    return M.marginals(px).join(after.withColumnRenamed("total", "t2"), "bin_id").select("bin_id", rounded(F.col("t2") / F.col("total"), 6).alias("ratio"))


@register("submatrix", sql("SELECT bin1, bin2, value FROM px WHERE bin1 BETWEEN 1000002 AND 1000012 AND bin2 BETWEEN 2000005 AND 2000020", *PX))
def submatrix(spark, d):
    return T.pixels(spark, d).where("bin1 BETWEEN 1000002 AND 1000012 AND bin2 BETWEEN 2000005 AND 2000020")


@register("symmetric_max", sql("SELECT least(bin1, bin2) AS bin1, greatest(bin1, bin2) AS bin2, max(value) AS value FROM full_px GROUP BY ALL", *PX, "full_px"))
def symmetric_max(spark, d):
    from ..frames import mirror

    x = mirror(T.pixels(spark, d)).select(F.least("bin1", "bin2").alias("bin1"), F.greatest("bin1", "bin2").alias("bin2"), "value")
    return spread(x, "bin1", "bin2").groupBy("bin1", "bin2").agg(F.max("value").alias("value"))


