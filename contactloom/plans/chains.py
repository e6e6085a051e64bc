"""Queries for the chains of domain calls, regions, capture interactions and their reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..frames import bin_of, chrom_of, cut, intra, rounded
from ..functions import strings
from ..operators import chains as C
from ..operators import features as X
from ..operators import matrix as M
from ..operators import pairs as P
from ..registry import register
from ..sources import tables as T
from ..sources import text
from .base import BINS, PX, sql
from .features import _CELLS, _DPX, _RANK, _REL, _SM, _V, _VP, _inputs, _profile, _r

_SIZES = (500, 5_000, 40_000)


@register("default_depths", "SELECT * FROM (VALUES (500, 15000, 30000, 2000), (5000, 50000, 200000, 10000), (40000, 200000, 400000, 80000)) t(size, least, most, step)")
def default_depths(spark, d):
    return spark.createDataFrame([(s, *C.default_depths(s)) for s in _SIZES], "size int, least int, most int, step int")


_BT = dict(
    q="SELECT bin_id, chrom, n, s, greatest(0, least(n - 1, bin_id % 1000000 + s * 3)) AS o FROM bins JOIN perchrom USING (chrom), (SELECT unnest([-1, 0, 1]) AS s)",
    q2="SELECT *, unnest(range(greatest(0, o - 3), o)) AS i FROM q WHERE o > 0",
    q3="SELECT *, unnest(range(o, least(n, o + 3))) AS j FROM q2",
    v="SELECT bin_id, s, coalesce(value, 0) AS value FROM q3 LEFT JOIN px ON bin1 = chrom * 1000000 + i AND bin2 = chrom * 1000000 + j",
    w="SELECT bin_id, s AS against, value, 2 AS side FROM v WHERE s <> 0 UNION ALL SELECT bin_id, a, value, 1 FROM v, (SELECT unnest([-1, 1]) AS a) WHERE s = 0",
    rk="SELECT *, rank() OVER (PARTITION BY bin_id, against ORDER BY value) + (count(*) OVER (PARTITION BY bin_id, against, value) - 1) / 2 AS r FROM w",
    t="SELECT bin_id, against, count(*) FILTER (side = 1) AS n1, count(*) FILTER (side = 2) AS n2, sum(r) FILTER (side = 1) AS w1 FROM rk GROUP BY 1, 2",
    z="SELECT bin_id, count(*) AS k, max(abs((w1 - n1 * (n1 + n2 + 1) / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12))) AS z FROM t WHERE n1 > 0 AND n2 > 0 GROUP BY 1",
)


@register("boundary_tests", sql("SELECT bin_id, round(CASE WHEN k = 2 THEN z END, 6) AS z FROM bins LEFT JOIN z USING (bin_id)", *PX, *BINS, **_BT))
def boundary_tests(spark, d):
    px, bins = _inputs(spark, d)
    return _r(C.boundary_tests(px, bins.select("bin_id"), bins, 3).select("bin_id", "z"), "z")


@register("bonferroni", "WITH p AS (SELECT o_orderkey AS id, o_totalprice / (SELECT max(o_totalprice) FROM orders) / 100 AS p FROM orders) SELECT id, round(least(1, p * (SELECT count(*) FROM p)), 9) AS p, least(1, p * (SELECT count(*) FROM p)) <= 0.5 AS significant FROM p")
def bonferroni(spark, d):
    o = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice")
    o = o.crossJoin(F.broadcast(o.agg(F.max("o_totalprice").alias("top")))).select("id", (F.col("o_totalprice") / F.col("top") / 100).alias("p"))
    return C.corrected(o, "bonferroni", 0.5).select("id", rounded("p", 9).alias("p"), "significant")


@register("boundaries_called")
def boundaries_called(spark, d):
    """No SQL: valleys come from a scan with state. Valley, depth, test and correction in one chain."""
    px, bins = _inputs(spark, d)
    return C.boundary_ranges(C.called_boundaries(px, bins, [3, 5, 8], 0.0, "none", 0.9), bins)


@register("domains_called")
def domains_called(spark, d):
    """No SQL, as above: the domains between called boundaries."""
    px, bins = _inputs(spark, d)
    return C.called_domains(C.called_boundaries(px, bins, [3, 5, 8], 0.0, "none", 0.9), bins)


_SCORED = "SELECT chrom, start, \"end\", id, (id * 7 % 10) / 10 AS score FROM doms"


def _scored(spark, d):
    return T.domains(spark, d).withColumn("score", F.pmod(F.col("id") * 7, F.lit(10)) / 10)


@register("domains_supported", sql('SELECT chrom, start, "end", id, score FROM (SELECT s.*, h.k IS NOT NULL AS hit, lag(score) OVER w AS a, lead(score) OVER w AS b FROM s LEFT JOIN (SELECT chrom AS c, start // 10000 * 10000 AS k FROM points GROUP BY 1, 2 HAVING count(*) >= 2) h ON h.c = s.chrom AND h.k = s.start WINDOW w AS (PARTITION BY chrom ORDER BY start, "end")) WHERE NOT coalesce(NOT hit AND abs(a - score) < 0.35 AND abs(b - score) < 0.35, false)', *BINS, "doms", "points", s=_SCORED))
def domains_supported(spark, d):
    return C.supported(_scored(spark, d), T.points(spark, d), T.BIN, 2, 0.35)


@register("relation_lines", sql("""SELECT a.chrom, '"' || a.id || '" -> "' || b.id || '";' AS line FROM u a JOIN u b ON a.chrom = b.chrom AND a.start < b."end" AND b.start < a."end" AND a.id <> b.id WHERE least(a."end", b."end") - greatest(a.start, b.start) >= 0.5 * (b."end" - b.start) AND (a."end" - a.start > b."end" - b.start OR (a."end" - a.start = b."end" - b.start AND a.id < b.id))""", *BINS, "doms", u='SELECT * FROM doms UNION ALL SELECT chrom, start + 10000, "end" + 20000, id + 500000 FROM doms'))
def relation_lines(spark, d):
    x = T.domains(spark, d)
    both = x.union(x.select("chrom", F.col("start") + 10_000, F.col("end") + 20_000, F.col("id") + 500_000))
    return C.relation_lines(X.domain_relations(both))


for _mode, _hows in (("all", ("one", "all")), ("left-inter-TAD", ("all",)), ("intra-TAD", ("one",))):
    for _how in _hows:
        _parts = {"all": ("intra", "left", "right"), "left-inter-TAD": ("intra", "left"), "intra-TAD": ("intra",)}[_mode]
        _test = (" OR " if _how == "one" else " AND ").join(f"coalesce(bool_or(abs(z) >= 1.6448536269514722) FILTER (part = '{x}'), false)" for x in _parts)

        @register(f"differential_verdicts_{_mode.split('-')[0]}_{_how}", sql(f"SELECT id, {_test} AS rejected FROM (SELECT id, part, (w - n1 * (n1 + n2 + 1) / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12) AS z FROM (SELECT id, part, count(*) FILTER (sample = 0) AS n1, count(*) FILTER (sample = 1) AS n2, sum(r) FILTER (sample = 0) AS w FROM ranked GROUP BY 1, 2) WHERE n1 > 0 AND n2 > 0) GROUP BY 1", *_DPX, c=_CELLS, v="SELECT id, part, sample, value FROM c UNION ALL SELECT id2, 'left', sample, value FROM c WHERE part = 'right'", ranked=_RANK))
        def _verdict(spark, d, mode=_mode, how=_how):
            t = X.differential_domains(T.pixels(spark, d, sample=0), T.pixels(spark, d, sample=1), T.domains(spark, d), T.BIN)
            return C.differential_verdicts(t, 0.1, mode, how)


_K = 'SELECT id, chrom, start, ("end" - 1) // 10000 - start // 10000 + 1 AS k FROM doms'


@register("domain_densities", sql("""SELECT id, part, coalesce(total, 0) AS total, coalesce(stored, 0) AS stored, cells, round(coalesce(stored, 0) / cells, 6) AS density, round(CASE WHEN i > 0 THEN coalesce(total, 0) / i END, 6) AS ratio
 FROM (SELECT id, 'intra' AS part, k * (k + 1) / 2 AS cells FROM k UNION ALL SELECT id, 'left', (k * lag(k) OVER (PARTITION BY chrom ORDER BY start))::DOUBLE FROM k UNION ALL SELECT id, 'right', (k * lead(k) OVER (PARTITION BY chrom ORDER BY start))::DOUBLE FROM k) LEFT JOIN s USING (id, part) LEFT JOIN (SELECT id, total AS i FROM s WHERE part = 'intra') USING (id) WHERE cells IS NOT NULL""",
    *PX, *BINS, "doms", k=_K, c=_CELLS.replace("value, sample FROM pxs", "value FROM px"), s="SELECT id, part, sum(value) AS total, count(*) AS stored FROM (SELECT id, part, value FROM c UNION ALL SELECT id2, 'left', value FROM c WHERE part = 'right') GROUP BY 1, 2"))
def domain_densities(spark, d):
    return _r(C.domain_densities(T.pixels(spark, d), T.domains(spark, d), T.BIN), "density", "ratio")


@register("file_resolution", "SELECT min(CASE WHEN regexp_extract((p_partkey * 500)::VARCHAR, '([1-9]0*)$', 1) <> '' THEN regexp_extract((p_partkey * 500)::VARCHAR, '([1-9]0*)$', 1)::BIGINT END) AS resolution FROM (SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 20)")
def file_resolution(spark, d):
    return C.file_resolution(T.table(spark, d, "part").select(F.col("p_partkey").alias("row"), (F.col("p_partkey") * 500).alias("start")))


# -- regions -----------------------------------------------------------------------------
def _regions(spark, d, size=17_000):
    return T.points(spark, d).select(F.col("id").alias("row"), "chrom", "start", (F.col("start") + size).alias("end"), F.when(F.col("id") % 3 == 0, "-").otherwise("+").alias("strand"))


_REG = "SELECT id AS row, chrom, start, start + 17000 AS \"end\", CASE WHEN id % 3 = 0 THEN '-' ELSE '+' END AS strand FROM points"
for _how, _at in (("first", "start // 10000"), ("last", "(\"end\" - 1) // 10000"), ("center", "(start // 10000 + (\"end\" - 1) // 10000) // 2")):

    @register(f"anchor_bins_{_how}", sql(f"SELECT row, chrom, chrom * 1000000 + {_at} AS bin_id, strand FROM r", "points", r=_REG))
    def _anchor(spark, d, how=_how):
        return C.anchor_bins(_regions(spark, d), T.BIN, how)


_A = "SELECT row, chrom, chrom * 1000000 + start // 10000 AS b, strand FROM r"
_AP = "SELECT least(x.b, y.b) AS bin1, greatest(x.b, y.b) AS bin2, arg_min(CASE WHEN x.b > y.b THEN y.strand || x.strand ELSE x.strand || y.strand END, (x.row, y.row)) AS strands FROM a x JOIN a y ON {on} WHERE x.b <> y.b GROUP BY 1, 2"
_ON = {"intra-chr": "x.chrom = y.chrom AND abs(x.b - y.b) BETWEEN 4 AND 20", "inter-chr": "x.chrom <> y.chrom", "all": "true"}
for _mode, _on in _ON.items():

    @register(f"anchor_pairs_{_mode.split('-')[0]}", sql("SELECT * FROM (" + _AP.format(on=_on) + ")", "points", r=_REG, a=_A))
    def _pairs_of(spark, d, mode=_mode):
        a = C.anchor_bins(_regions(spark, d), T.BIN)
        return C.anchor_pairs(a, a, mode, 4, 20)


@register("anchor_pairs_rows", sql("SELECT least(x.b, y.b) AS bin1, greatest(x.b, y.b) AS bin2, arg_min(CASE WHEN x.b > y.b THEN y.strand || x.strand ELSE x.strand || y.strand END, (x.row, y.row)) AS strands FROM a x JOIN (SELECT row, b + 7 AS b, strand FROM a) y USING (row) GROUP BY 1, 2", "points", r=_REG, a=_A))
def anchor_pairs_rows(spark, d):
    a = C.anchor_bins(_regions(spark, d), T.BIN)
    return C.anchor_pairs(a, a.withColumn("bin_id", F.col("bin_id") + 7), "row-wise")


_OW = dict(
    r=_REG, a=_A, ap=_AP.format(on=_ON["intra-chr"]),
    f="SELECT ap.* FROM ap JOIN perchrom ON chrom = bin1 // 1000000 WHERE bin1 % 1000000 >= 3 AND bin2 % 1000000 + 3 < n",
    w0="SELECT f.bin1, f.bin2, strands AS s, i, j, coalesce(px.value, 0) AS value FROM f CROSS JOIN (SELECT unnest(range(-3, 4)) AS i) CROSS JOIN (SELECT unnest(range(-3, 4)) AS j) LEFT JOIN px ON px.bin1 = least(f.bin1 + i, f.bin2 + j) AND px.bin2 = greatest(f.bin1 + i, f.bin2 + j)",
    w="SELECT bin1, bin2, CASE s WHEN '-+' THEN -i WHEN '--' THEN j ELSE i END AS dr, CASE s WHEN '+-' THEN -j WHEN '--' THEN i ELSE j END AS dc, value FROM w0 QUALIFY sum(value) OVER (PARTITION BY bin1, bin2) <> 0",
)


def _windows(spark, d):
    px, bins = _inputs(spark, d)
    a = C.anchor_bins(_regions(spark, d), T.BIN)
    return C.oriented_windows(px, C.fitting(C.anchor_pairs(a, a, "intra-chr", 4, 20), bins, 3), 3)


@register("pile_up_oriented", sql("SELECT dr, dc, round(avg(value), 6) AS value FROM w GROUP BY 1, 2", *PX, *BINS, "points", **_OW))
def pile_up_oriented(spark, d):
    return _r(_windows(spark, d).groupBy("dr", "dc").agg(F.avg("value").alias("value")), "value")


@register("pile_up_zscore", sql("SELECT dr, dc, round(avg(value), 6) AS value FROM w GROUP BY 1, 2", *PX, "intra", *BINS, "points", s="SELECT chrom, d, sum(value) / (n - d) AS mu, sum(value * value) / (n - d) AS m2 FROM intra JOIN perchrom USING (chrom) GROUP BY chrom, d, n",
    zs="SELECT bin1, bin2, CASE WHEN sqrt(greatest(0, m2 - mu * mu)) > 1e-12 THEN (value - mu) / sqrt(greatest(0, m2 - mu * mu)) ELSE 0 END AS value FROM intra JOIN s USING (chrom, d)", **{k: v.replace("LEFT JOIN px ON", "LEFT JOIN zs px ON") for k, v in _OW.items()}))
def pile_up_zscore(spark, d):
    """Windows of z-scores, turned by strand."""
    px, bins = _inputs(spark, d)
    a = C.anchor_bins(_regions(spark, d), T.BIN)
    w = C.oriented_windows(M.zscore(px, bins), C.fitting(C.anchor_pairs(a, a, "intra-chr", 4, 20), bins, 3), 3)
    return _r(w.groupBy("dr", "dc").agg(F.avg("value").alias("value")), "value")


@register("window_outliers", sql("SELECT DISTINCT bin1, bin2 FROM w, (SELECT median(value) AS m, 1.4826 * median(abs(value)) AS s FROM w) WHERE s > 0 AND abs(value - m) / s > 0.8", *PX, *BINS, "points", **_OW))
def window_outliers(spark, d):
    return C.outlier_windows(_windows(spark, d), 0.8)


@register("window_diagonals", sql("SELECT bin1, bin2, array_to_string(list(value::BIGINT ORDER BY dr), ',') AS features FROM w WHERE dr = dc GROUP BY 1, 2", *PX, *BINS, "points", **_OW))
def window_diagonals(spark, d):
    x = C.window_features(_windows(spark, d), "diagonal")
    return x.select("bin1", "bin2", F.array_join(F.transform("features", lambda v: v.cast("bigint").cast("string")), ",").alias("features"))


@register("window_clusters")
def window_clusters(spark, d):
    """No SQL: k-means over windows."""
    return C.window_clusters(_windows(spark, d), 3)


_AV = "SELECT chrom * 1000000 + {o} - 2 AS base, strand FROM r JOIN perchrom USING (chrom) WHERE {o} >= 2 AND {o} + 3 <= n"
for _at, _o in (("start", "start // 10000"), ("center", "((start + \"end\") // 2) // 10000"), ("end", "\"end\" // 10000")):

    @register(f"average_regions_{_at}", sql("SELECT CASE WHEN strand = '-' THEN j ELSE i END AS r, CASE WHEN strand = '-' THEN i ELSE j END AS c, round(sum(value) / (SELECT count(*) FROM av), 6) AS value FROM av, (SELECT unnest(range(5)) AS i), (SELECT unnest(range(5)) AS j), px WHERE bin1 = least(base + i, base + j) AND bin2 = greatest(base + i, base + j) GROUP BY 1, 2", *PX, *BINS, "points", r=_REG, av=_AV.format(o=_o)))
    def _average(spark, d, at=_at):
        px, bins = _inputs(spark, d)
        return _r(C.average_regions(px, _regions(spark, d), bins, T.BIN, 2, 3, at), "value")


# -- capture -----------------------------------------------------------------------------
def _relative(spark, d):
    return X.relative(X.smooth(_profile(spark, d)), 15)


def _named(spark, d):
    return T.points(spark, d).withColumn("bin_id", bin_of("chrom", "start", T.BIN))


_INTER = "SELECT id, bin_id // 1000000 AS chrom, (bin_id % 1000000 + rel_pos) * 10000 AS start, (bin_id % 1000000 + rel_pos + 1) * 10000 AS \"end\", gene, sum(raw) OVER (PARTITION BY id) AS sum, rel_pos * 10000 AS rel_pos, round(relative, 6) AS relative, raw FROM rel JOIN points USING (id)"


@register("interaction_table", sql(_INTER, *_V, vp=_VP, sm=_SM, rel=_REL))
def interaction_table(spark, d):
    return _r(C.interactions(_relative(spark, d), _named(spark, d), T.BIN), "relative")


@register("viewpoint_rbz", sql("SELECT id, rel_pos, round(CASE WHEN e IS NULL OR e = 0 THEN -1 ELSE (relative - m) / e END, 5) AS score FROM rel JOIN (SELECT rel_pos, avg(relative) AS m, stddev_samp(relative) / sqrt(count(*)) AS e FROM rel GROUP BY 1) USING (rel_pos)", *_V, vp=_VP, sm=_SM, rel=_REL))
def viewpoint_rbz(spark, d):
    p = _relative(spark, d)
    b = p.groupBy("rel_pos").agg(F.avg("relative").alias("m"), (F.stddev_samp("relative") / F.sqrt(F.count(F.lit(1)))).alias("e"))
    return p.join(F.broadcast(b), "rel_pos").select("id", "rel_pos", rounded(C.rbz(F.col("relative"), F.col("m"), F.col("e")), 5).alias("score"))  # a row per position


_QS2 = " UNION ALL ".join(f"SELECT id, {s} AS sample, count(*) FILTER (raw > 0) / count(*) AS q FROM ({_VP.replace('LEFT JOIN px ON', f'LEFT JOIN (SELECT * FROM pxs WHERE sample = {s}) px ON')}) GROUP BY 1" for s in (0, 1))


@register("points_accepted", sql("SELECT id, CASE WHEN min(q) < 0 THEN 'faulty' WHEN max(q) > 0.9 THEN 'accepted' ELSE 'rejected' END AS verdict FROM q GROUP BY 1", "mates", "pairs", "pxs", *BINS, "points", q=_QS2))
def points_accepted(spark, d):
    q = None
    for s in (0, 1):
        x = X.point_quality(_profile(spark, d, s), 0.9).select("id", F.lit(s).alias("sample"), "sparsity")
        q = x if q is None else q.union(x)
    return C.accepted_points(q, 0.9)


@register("viewpoint_preselected", sql("SELECT id, rel_pos, raw FROM vp WHERE raw >= 5 + abs(rel_pos) % 4", *_V, vp=_VP))
def viewpoint_preselected(spark, d):
    limits = spark.range(-20, 21).select(F.col("id").alias("rel_pos"), (5 + F.abs("id") % 4).cast("double").alias("value"))
    return C.preselect(_profile(spark, d), "raw", limits)


@register("viewpoint_significant")
def viewpoint_significant(spark, d):
    """No SQL: merged runs tested again in a fitted background."""
    p = _relative(spark, d)
    return C.retested(X.significant_runs(C.preselect(p, "raw", 5.0)), X.background(p), 0.5)


@register("viewpoint_by_p", sql("SELECT id, rel_pos, raw, p FROM (SELECT id, rel_pos, raw, 1.0 / (1 + raw) AS p FROM vp) WHERE p <= 0.2 AND raw >= 6", *_V, vp=_VP))
def viewpoint_by_p(spark, d):
    return C.by_p_value(_profile(spark, d).withColumn("p", 1 / (1 + F.col("raw"))), 0.2, 6.0)


@register("sample_pairs", "SELECT DISTINCT a.c_nationkey AS sample1, b.c_nationkey AS sample2 FROM customer a JOIN customer b ON a.c_nationkey < b.c_nationkey")
def sample_pairs(spark, d):
    return C.sample_pairs(T.table(spark, d, "customer").select(F.col("c_nationkey").alias("sample")))


_SIG = "SELECT id, rel_pos * 10000 AS start, (rel_pos + 1) * 10000 AS e FROM vp WHERE raw >= 8"
_TR = """SELECT id, min(start) AS start, max(e) AS "end" FROM (SELECT *, sum(n) OVER (PARTITION BY id ORDER BY start, e ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN start <= max(e) OVER (PARTITION BY id ORDER BY start, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 10000 THEN 0 ELSE 1 END AS n FROM sig)) GROUP BY id, g"""


def _targets(spark, d):
    hits = _profile(spark, d).where("raw >= 8").select("id", (F.col("rel_pos") * T.BIN).alias("start"), ((F.col("rel_pos") + 1) * T.BIN).alias("end"))
    return C.target_regions(hits, T.BIN)


@register("target_regions", sql('SELECT id, start, "end" FROM tr', *_V, vp=_VP, sig=_SIG, tr=_TR))
def target_regions(spark, d):
    return _targets(spark, d)


@register("aggregate_on_targets", sql('SELECT id, t_start, t_end, count(*) AS n, sum(raw) AS raw FROM (SELECT v.id, v.raw, min(t.start) AS t_start, arg_min(t."end", (t.start, t."end")) AS t_end FROM vp v JOIN tr t ON v.id = t.id AND v.rel_pos * 10000 < t."end" AND t.start < (v.rel_pos + 1) * 10000 GROUP BY v.id, v.rel_pos, v.raw) GROUP BY 1, 2, 3', *_V, vp=_VP, sig=_SIG, tr=_TR))
def aggregate_on_targets(spark, d):
    p = _profile(spark, d).select("id", (F.col("rel_pos") * T.BIN).alias("start"), ((F.col("rel_pos") + 1) * T.BIN).alias("end"), "raw", "rel_pos")
    return C.on_targets(p, _targets(spark, d))


@register("plain_viewpoint", sql("SELECT bin2 AS bin_id, sum(value) AS value FROM full_px WHERE bin1 BETWEEN 1000001 AND 1000003 AND bin2 BETWEEN 1000000 AND 1000030 GROUP BY 1", *PX, "full_px"))
def plain_viewpoint(spark, d):
    return C.plain_viewpoint(T.pixels(spark, d), 1_000_001, 1_000_003, 1_000_000, 1_000_030)


@register("text_export", sql("SELECT chrom, start, \"end\", gene, sum, rel_pos, raw FROM i WHERE chrom = 2", *_V, vp=_VP, sm=_SM, rel=_REL, i=_INTER))
def text_export(spark, d):
    """The interaction table as text with a folder per chromosome, one of which is read."""
    x = C.interactions(_relative(spark, d), _named(spark, d), T.BIN).select("chrom", "start", "end", "gene", "sum", "rel_pos", "raw")
    path = text.new_path(spark)
    x.write.partitionBy("chrom").csv(path, sep="\t")
    got = spark.read.schema("start bigint, end bigint, gene string, sum double, rel_pos bigint, raw double, chrom bigint").csv(path, sep="\t")
    return got.where("chrom = 2").select(*x.columns)


# -- loops -------------------------------------------------------------------------------
@register("loop_places", sql('SELECT a.chrom AS chrom1, a.start AS start1, a."end" AS end1, b.chrom AS chrom2, b.start AS start2, b."end" AS end2, value FROM intra JOIN bins a ON a.bin_id = bin1 JOIN bins b ON b.bin_id = bin2 WHERE b.start - a.start <= 50000', *PX, "intra", *BINS))
def loop_places(spark, d):
    px, bins = _inputs(spark, d)
    return C.loop_places(px.where(intra()), bins, 50_000)


_L2 = 'SELECT id, chrom AS chrom1, start AS start1, start + 12000 AS end1, 1 + chrom % 5 AS chrom2, start + 3000 AS start2, start + 9000 AS end2 FROM points'


@register("loops_with_contacts", sql("SELECT id FROM l WHERE EXISTS (SELECT 1 FROM full_px WHERE bin1 // 1000000 = chrom1 AND bin1 % 1000000 BETWEEN start1 // 10000 AND (end1 - 1) // 10000 AND bin2 // 1000000 = chrom2 AND bin2 % 1000000 BETWEEN start2 // 10000 AND (end2 - 1) // 10000 AND value >= 12)", *PX, "full_px", "points", l=_L2))
def loops_with_contacts(spark, d):
    p = T.points(spark, d)
    x = p.select("id", F.col("chrom").alias("chrom1"), F.col("start").alias("start1"), (F.col("start") + 12_000).alias("end1"), (1 + F.col("chrom") % 5).alias("chrom2"), (F.col("start") + 3000).alias("start2"), (F.col("start") + 9000).alias("end2"))
    return C.loops_with_contacts(x, T.pixels(spark, d).where("value >= 12"), T.BIN).select("id")


@register("boundaries_with_peaks", sql("""SELECT id FROM iv b WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT chrom, start // 1000 * 1000 AS start, ("end" // 1000 + 1) * 1000 AS "end" FROM iv WHERE score > 80) p WHERE p.chrom = b.chrom AND p.start < b."end" AND b.start < p."end")""", "iv"))
def boundaries_with_peaks(spark, d):
    iv = T.intervals(spark, d)
    return C.boundaries_with_peaks(iv, iv.where("score > 80"), 1000).select("id")


@register("loop_search", sql("SELECT least, ratio, (SELECT count(*) FROM intra JOIN (SELECT d, sum(value) / count(*) AS e FROM intra GROUP BY 1) USING (d) WHERE d BETWEEN 1 AND 30 AND value >= least AND value / e >= ratio)::DOUBLE AS score FROM (SELECT unnest([5.0, 10.0])::DOUBLE AS least), (SELECT unnest([1.1, 1.3])::DOUBLE AS ratio)", *PX, "intra"))
def loop_search(spark, d):
    """Options of the loop search with the number of candidates each leaves."""
    px, bins = _inputs(spark, d)
    oe = M.obs_exp(px, bins, "non_zero")
    found = C.search({"least": [5.0, 10.0], "ratio": [1.1, 1.3]}, lambda least, ratio: X.loop_candidates(px, oe, 30, least, ratio).count())
    return spark.createDataFrame([(o["least"], o["ratio"], s) for s, o in found], "least double, ratio double, score double")


# -- tracks ------------------------------------------------------------------------------
@register("track_flip_mark", sql("SELECT bin_id, round(CASE WHEN u < w AND u <> 0 AND w <> 0 THEN -value ELSE value END, 6) AS value FROM j JOIN (SELECT bin_id // 1000000 AS c, avg(n) FILTER (value > 0) AS u, avg(n) FILTER (value < 0) AS w FROM j GROUP BY 1) ON c = bin_id // 1000000", "points", "track", j="SELECT bin_id, value, coalesce(n, 0) AS n FROM track LEFT JOIN (SELECT bin_id, count(*) AS n FROM points GROUP BY 1) USING (bin_id)"))
def track_flip_mark(spark, d):
    m = T.points(spark, d).groupBy(bin_of("chrom", "start", T.BIN).alias("bin_id")).agg(F.count(F.lit(1)).cast("double").alias("signal"))
    return _r(C.flip_by_mark(T.tracks(spark, d), m), "value")


@register("quantiles_trimmed", sql("SELECT bin_id, len(list_filter(range(10), lambda k: e[1] + (e[2] - e[1]) * k / 9 <= value)) AS q FROM track, (SELECT quantile_cont(value, [0.05, 0.95]) AS e FROM track)", "track"))
def quantiles_trimmed(spark, d):
    return C.trimmed_quantiles(T.tracks(spark, d), 10, 5)


_HIST = "SELECT k, coalesce(n, 0) AS n FROM (SELECT unnest(range(20)) AS k) LEFT JOIN (SELECT least(floor((t - lo) / (hi - lo) * 20), 19)::INT AS k, count(*) AS n FROM m, (SELECT min(t) AS lo, max(t) AS hi FROM m) GROUP BY 1) USING (k)"


@register("suggested_threshold", sql("SELECT round(lo + k * (hi - lo) / 20, 6) AS threshold FROM (SELECT min(k) AS k FROM (SELECT k, n, lag(n) OVER (ORDER BY k) AS a, lead(n) OVER (ORDER BY k) AS b FROM h) WHERE a > n AND n < b), (SELECT min(t) AS lo, max(t) AS hi FROM m)", *PX, "full_px", m="SELECT bin1, sum(value) AS t FROM full_px WHERE bin1 <> bin2 GROUP BY 1", h=_HIST))
def suggested_threshold(spark, d):
    return _r(C.suggested_threshold(M.marginals(T.pixels(spark, d).where("bin1 <> bin2")), 20), "threshold")


@register("without_outliers", "SELECT p_partkey FROM part, (SELECT median(p_retailprice) AS m FROM part), (SELECT 1.4826 * median(abs(p_retailprice - (SELECT median(p_retailprice) FROM part))) AS s FROM part) WHERE s = 0 OR abs(p_retailprice - m) / s <= 1.0")
def without_outliers(spark, d):
    return C.without_outliers(T.table(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 1.0).select("p_partkey")


@register("rescaled_matrix", sql("SELECT bin1, bin2, round((value - lo) / (hi - lo), 6) AS value FROM px, (SELECT min(value) AS lo, max(value) AS hi FROM px)", *PX))
def rescaled_matrix(spark, d):
    px = T.pixels(spark, d)
    return px.crossJoin(F.broadcast(px.agg(F.min("value").alias("lo"), F.max("value").alias("hi")))).select("bin1", "bin2", rounded(C.rescaled(F.col("value"), F.col("lo"), F.col("hi")), 6).alias("value"))


@register("transform_per_chromosome", sql("SELECT bin1, bin2, round(value / e, 6) AS value FROM intra JOIN (SELECT chrom, d, sum(value) / count(*) AS e FROM intra GROUP BY 1, 2) USING (chrom, d)", *PX, "intra"))
def transform_per_chromosome(spark, d):
    return _r(C.transform(*_inputs(spark, d), "obs_exp_non_zero", per_chrom=True), "value")


@register("short_long_test", sql("SELECT n1, n2, round((w - n1 * (n1 + n2 + 1) / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12), 6) AS z FROM (SELECT count(*) FILTER (sample = 0) AS n1, count(*) FILTER (sample = 1) AS n2, sum(k) FILTER (sample = 0) AS w FROM (SELECT *, rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2 AS k FROM r)) WHERE n1 > 0 AND n2 > 0", "mates", "pairs", "pxs", r="SELECT sample, bin1 // 1000000 AS c, sum(value) FILTER (bin2 - bin1 <= 10) / sum(value) FILTER (bin2 - bin1 > 10) AS r FROM pxs WHERE bin1 // 1000000 = bin2 // 1000000 GROUP BY 1, 2 HAVING sum(value) FILTER (bin2 - bin1 > 10) > 0"))
def short_long_test(spark, d):
    """Rank sum of the samples' ratios over chromosomes."""
    x = None
    for s in (0, 1):
        y = M.short_long(T.pixels(spark, d, sample=s), 10).select(F.lit(1).alias("k"), F.lit(s + 1).alias("side"), F.col("ratio").alias("value"))
        x = y if x is None else x.union(y)
    return _r(X.rank_sum(x, ["k"]).select("n1", "n2", "z"), "z")


@register("decay_rollup", sql("SELECT coalesce(chrom, 0) AS chrom, d, sum(value) AS total, count(*) AS stored FROM intra GROUP BY GROUPING SETS ((chrom, d), (d))", *PX, "intra"))
def decay_rollup(spark, d):
    """Sums per distance for each chromosome and for all (0) in one pass."""
    x = T.pixels(spark, d).where(intra()).select(chrom_of("bin1").alias("chrom"), (F.col("bin2") - F.col("bin1")).alias("d"), "value")
    return x.rollup("d", "chrom").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("stored"), F.grouping("d").alias("g")).where("g = 0").select(F.coalesce("chrom", F.lit(0)).alias("chrom"), "d", "total", "stored")


@register("moving_sum", sql("SELECT id, round(sum(score) OVER (PARTITION BY chrom ORDER BY start RANGE BETWEEN 600 PRECEDING AND 600 FOLLOWING), 4) AS around FROM iv", "iv"))
def moving_sum(spark, d):
    iv = T.intervals(spark, d).select("id", "chrom", "start", F.col("score").alias("value"))
    return C.moving_sum(iv, 600).select("id", rounded("around", 4).alias("around"))


@register("last_before", "SELECT a.event_id AS id, (SELECT max(b.ts) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'view' AND b.ts <= a.ts) IS NOT NULL AS seen, floor(epoch(a.ts))::BIGINT - floor(epoch((SELECT max(b.ts) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'view' AND b.ts <= a.ts)))::BIGINT AS gap FROM events a WHERE a.event_type = 'purchase'")
def last_before(spark, d):
    """As-of join: each purchase with the time since its user's last view."""
    e = T.table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    x = C.last_before(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'view'").select("user_id", "ts", F.col("ts").alias("seen_at")), "user_id", "ts", "seen_at")
    return x.select(F.col("event_id").alias("id"), F.col("seen_at").isNotNull().alias("seen"), (F.unix_timestamp("ts") - F.unix_timestamp("seen_at")).alias("gap"))


@register("shown_matrix", sql("SELECT x AS bin1, y AS bin2, round(ln(greatest(v, (SELECT min(v) FROM c WHERE v > 0))), 6) AS value FROM c", *PX, c="SELECT x, y, coalesce(value, 0) AS v FROM (SELECT unnest(range(1000000, 1000008)) AS x), (SELECT unnest(range(3000000, 3000006)) AS y) LEFT JOIN px ON bin1 = x AND bin2 = y"))
def shown_matrix(spark, d):
    return _r(C.shown_matrix(T.pixels(spark, d), 1_000_000, 1_000_007, 3_000_000, 3_000_005, log=True), "value")


@register("clean_values", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 IN (0, 1, 2) THEN 0 ELSE o_totalprice END AS value FROM orders")
def clean_values(spark, d):
    v = F.when(F.col("o_orderkey") % 5 == 0, F.lit(float("nan"))).when(F.col("o_orderkey") % 5 == 1, F.lit(float("inf"))).when(F.col("o_orderkey") % 5 == 2, F.lit(None)).otherwise(F.col("o_totalprice"))
    return T.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), M.clean(v).alias("value"))


@register("mean_and_median", sql("SELECT chrom, round(avg(score), 6) AS mean, round(median(score), 6) AS median FROM iv GROUP BY 1", "iv"))
def mean_and_median(spark, d):
    return _r(T.intervals(spark, d).groupBy("chrom").agg(F.avg("score").alias("mean"), F.median("score").alias("median")), "mean", "median")


@register("low_coverage_bins", sql("SELECT bin1 AS bin_id, sum(value) AS total FROM full_px WHERE bin1 <> bin2 GROUP BY 1 HAVING sum(value) < (SELECT avg(t) FROM (SELECT sum(value) AS t FROM full_px WHERE bin1 <> bin2 GROUP BY bin1))", *PX, "full_px"))
def low_coverage_bins(spark, d):
    """Bins with fewer contacts off the diagonal than the mean, as text and read back."""
    m = M.marginals(T.pixels(spark, d).where("bin1 <> bin2"))
    low = m.crossJoin(F.broadcast(m.agg(F.avg("total").alias("mean")))).where("total < mean").select("bin_id", "total")
    path = text.write_fields(low, text.new_path(spark))
    return text.fields(text.lines(spark, path), ("bin_id bigint", "total double"))


# -- pairs -------------------------------------------------------------------------------
@register("pairs_fractions", sql("""SELECT part, key, n, round(n / CASE part WHEN 'mapping' THEN sequenced WHEN 'discarded' THEN usable WHEN 'distance' THEN accepted ELSE inward + outward + l + r END, 6) AS fraction FROM c, LATERAL (SELECT unnest(['mapping', 'mapping', 'mapping', 'mapping', 'discarded', 'distance', 'distance', 'distance', 'orientation', 'orientation', 'orientation', 'orientation']) AS part,
 unnest(['accepted', 'low_quality', 'not_unique', 'unmapped', 'duplicates', 'different_chromosome', 'short_range', 'long_range', 'inward', 'outward', 'same_strand_left', 'same_strand_right']) AS key, unnest([accepted, low_quality, not_unique, unmapped, usable - accepted, inter, short_range, long_range, inward, outward, l, r]) AS n)""",
    "mates", "pairs", "classed", "accepted", c="SELECT *, sequenced - unmapped - not_unique - low_quality AS usable FROM (SELECT count(*) AS sequenced, count(*) FILTER (q = 'one mate unmapped') AS unmapped, count(*) FILTER (q = 'one mate not unique') AS not_unique, count(*) FILTER (q = 'one mate low quality') AS low_quality FROM classed), (SELECT count(*) AS accepted, count(*) FILTER (o = 'inward') AS inward, count(*) FILTER (o = 'outward') AS outward, count(*) FILTER (o = 'same-strand-left') AS l, count(*) FILTER (o = 'same-strand-right') AS r, count(*) FILTER (chrom1 <> chrom2) AS inter, count(*) FILTER (len = 'short') AS short_range, count(*) FILTER (len = 'long') AS long_range FROM accepted)"))
def pairs_fractions(spark, d):
    return _r(P.qc_fractions(P.qc(T.pairs(spark, d))), "fraction")


_SEQ = "CASE WHEN read_id % 4 = 0 THEN 'gatcACGTTTAA' WHEN read_id % 4 = 1 THEN 'AACCTTgatc' ELSE 'AAAACCCCAAAA' END"


@register("pairs_dangling", sql(f"SELECT count(*) AS n FROM (SELECT *, upper({_SEQ}) AS s FROM classed) WHERE NOT (o = 'inward' AND abs(pos1 - pos2) < 30000 AND (CASE WHEN rev1 THEN ends_with(s, 'GATC') ELSE starts_with(s, 'GATC') END OR CASE WHEN rev2 THEN ends_with(s, 'GATC') ELSE starts_with(s, 'GATC') END))", "mates", "pairs", "classed"))
def pairs_dangling(spark, d):
    s = F.when(F.col("read_id") % 4 == 0, "gatcACGTTTAA").when(F.col("read_id") % 4 == 1, "AACCTTgatc").otherwise("AAAACCCCAAAA")
    return P.without_dangling(T.pairs(spark, d).withColumns({"seq1": s, "seq2": s}), "GATC", 30_000).agg(F.count(F.lit(1)).alias("n"))


@register("string_functions", "SELECT p_partkey AS id, translate(reverse(upper(p_name)), 'ACGTRYKMBVDH', 'TGCAYRMKVBHD') AS complement, translate('chr' || p_name || ',;|', ',;|!{}()', '') AS plain, ltrim('hcr' || p_name, 'chr') AS stripped, p_name AS bare, 'chr' || p_name AS added FROM part")
def string_functions(spark, d):
    n = F.col("p_name")
    named = F.concat(F.lit("chr"), n)
    return T.table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), strings.reverse_complement(n).alias("complement"), strings.plain_name(F.concat(named, F.lit(",;|"))).alias("plain"),
        text.strip_letters(F.concat(F.lit("hcr"), n)).alias("stripped"), text.with_prefix(named, "remove").alias("bare"), text.with_prefix(n, "add").alias("added"),
    )


# -- learning ----------------------------------------------------------------------------
def _learning(spark, d):
    px, bins = _inputs(spark, d)
    return C.near_labels(X.boundary_features(px, bins, 3), T.domains(spark, d), T.BIN)


@register("boundary_labels", sql("SELECT bin_id, (EXISTS (SELECT 1 FROM doms WHERE doms.chrom = bins.chrom AND abs(doms.start - bins.start) <= 10000))::INT AS label FROM bins JOIN perchrom USING (chrom) WHERE bin_id % 1000000 >= 3 AND bin_id % 1000000 + 3 < n", *BINS, "doms"))
def boundary_labels(spark, d):
    px, bins = _inputs(spark, d)
    return C.near_labels(X.boundary_features(px, bins, 3), T.domains(spark, d), T.BIN, 1).select("bin_id", F.col("label").cast("int").alias("label"))


@register("boundary_votes")
def boundary_votes(spark, d):
    """No SQL: a bag of boosted trees on as many rows of either class."""
    x = cut(_learning(spark, d))  # made once, read by each pass of the trees
    return C.vote(C.bag_of_boosted(C.undersampled(x)), x)


@register("predicted_domains", sql('SELECT chrom, start, e AS "end", k FROM (SELECT chrom, start, lead(start) OVER w AS e, row_number() OVER w AS k FROM (SELECT chrom, start, lag(start) OVER (PARTITION BY chrom ORDER BY start) AS b FROM doms) WHERE b IS NULL OR b + 49999 <= start WINDOW w AS (PARTITION BY chrom ORDER BY start)) WHERE e IS NOT NULL', *BINS, "doms"))
def predicted_domains(spark, d):
    b = T.domains(spark, d).select(bin_of("chrom", "start", T.BIN).alias("bin_id"), F.lit(1).alias("boundary"))
    return C.predicted_domains(b, T.BIN)


@register("confusion", "SELECT *, round((tp + tn) / n, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM (SELECT count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp, count(*) FILTER (y AND NOT p) AS fn, count(*) FILTER (NOT y AND NOT p) AS tn, count(*) AS n FROM (SELECT p_size > 25 AS y, p_partkey % 3 > 0 AS p FROM part))")
def confusion(spark, d):
    x = T.table(spark, d, "part").select((F.col("p_size") > 25).cast("int").alias("label"), (F.col("p_partkey") % 3 > 0).cast("int").alias("boundary"))
    out = C.confusion(x)
    return _r(out.withColumn("n", F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), "accuracy", "precision", "recall", "f1")


# -- streams -----------------------------------------------------------------------------
@register("stream_windows", "SELECT (epoch(date_trunc('day', ts)))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    from ..streaming import contacts

    return contacts.finished(contacts.windows(contacts.source(spark, d, "events")), "complete")


@register("stream_distinct", "SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem")
def stream_distinct(spark, d):
    from ..streaming import contacts

    return contacts.finished(contacts.distinct_contacts(contacts.source(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")))
