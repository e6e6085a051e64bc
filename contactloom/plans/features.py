"""Queries for domains, loops, compartments, pile-ups, viewpoints and boundary learning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..frames import bin_of, chrom_of, cut, offset_of, rounded
from ..operators import features as X
from ..operators import matrix as M
from ..registry import register
from ..sources import tables as T
from .base import BINS, PX, sql

_W = (3, 5, 8)
_CUTS = "SELECT bin_id, chrom, bin_id % 1000000 AS o, n, w FROM bins JOIN perchrom USING (chrom), (SELECT unnest([3, 5, 8]) AS w) WHERE bin_id % 1000000 > 0"
_SCORES = "SELECT c.bin_id, w, coalesce(sum(value), 0) / (least(w, o) * least(w, n - o)) AS score FROM cuts c LEFT JOIN px ON bin1 < bin_id AND bin2 >= bin_id AND bin1 >= bin_id - w AND bin2 < bin_id + w AND bin1 // 1000000 = chrom AND bin2 // 1000000 = chrom GROUP BY c.bin_id, w, o, n"
_MEAN = "SELECT bin_id, avg(score) AS score FROM sc GROUP BY 1"


def _inputs(spark, d):
    return T.pixels(spark, d), T.fixed_bins(spark, d)


def _r(df, *columns):
    return df.withColumns({c: rounded(c) for c in columns})


def _scores(spark, d):
    return X.mean_score(X.diamonds(*_inputs(spark, d), list(_W)))


@register("domain_scores", sql("SELECT bin_id, w, round(score, 6) AS score FROM sc", *PX, *BINS, cuts=_CUTS, sc=_SCORES))
def domain_scores(spark, d):
    return _r(X.diamonds(*_inputs(spark, d), list(_W)), "score")


@register("domain_mean_score", sql("SELECT bin_id, round(score, 6) AS score FROM m", *PX, *BINS, cuts=_CUTS, sc=_SCORES, m=_MEAN))
def domain_mean(spark, d):
    return _r(_scores(spark, d), "score")


_DELTA = "SELECT bin_id, score, CASE WHEN lag(score, 10) OVER w IS NOT NULL AND lead(score, 9) OVER w IS NOT NULL THEN (sum(score) OVER (w ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING) - lead(score, 3) OVER w) / 19 - score END AS delta FROM m WINDOW w AS (PARTITION BY bin_id // 1000000 ORDER BY bin_id)"


@register("domain_deltas", sql(f"SELECT bin_id, round(score, 6) AS score, round(delta, 6) AS delta FROM ({_DELTA})", *PX, *BINS, cuts=_CUTS, sc=_SCORES, m=_MEAN))
def domain_deltas(spark, d):
    return _r(X.deltas(_scores(spark, d)), "score", "delta")


@register("domain_valleys")
def domain_valleys(spark, d):
    """No SQL: a scan with state."""
    return X.valleys(_scores(spark, d))


@register("domains", sql("SELECT chrom, pos AS start, e AS \"end\", round(score, 6) AS score, k FROM (SELECT *, lead(pos) OVER w AS e, row_number() OVER w AS k FROM (SELECT bin_id // 1000000 AS chrom, bin_id % 1000000 * 10000 AS pos, score FROM x WHERE delta >= 0.1) WINDOW w AS (PARTITION BY chrom ORDER BY pos)) WHERE e IS NOT NULL", *PX, *BINS, cuts=_CUTS, sc=_SCORES, m=_MEAN, x=_DELTA))
def domains(spark, d):
    b = X.deltas(_scores(spark, d)).where("delta >= 0.1").select(chrom_of("bin_id").alias("chrom"), (offset_of("bin_id") * T.BIN).alias("pos"), "score")
    return _r(X.domains_of(b), "score")




@register("multiple_testing", "WITH p AS (SELECT o_orderkey AS id, o_totalprice / (SELECT max(o_totalprice) FROM orders) AS p FROM orders), r AS (SELECT p, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS rank FROM p) SELECT id, round(p, 9) AS p, coalesce(p <= (SELECT max(p) FROM r WHERE p <= 0.9 * rank / (SELECT count(*) FROM p)), false) AS significant FROM p")
def multiple_testing(spark, d):
    o = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice")
    o = o.crossJoin(F.broadcast(o.agg(F.max("o_totalprice").alias("top")))).select("id", (F.col("o_totalprice") / F.col("top")).alias("p"))
    return X.benjamini_hochberg(o, "p", 0.9).select("id", rounded("p", 9).alias("p"), "significant")


_D2 = 'SELECT chrom, start + CASE WHEN id % 3 = 0 THEN 0 ELSE 10000 END AS start, "end" + CASE WHEN id % 3 = 0 THEN 0 ELSE 20000 END AS "end", id + 500000 AS id FROM doms'


def _second(spark, d):
    x = T.domains(spark, d)
    same = F.col("id") % 3 == 0
    return x.select("chrom", (F.col("start") + F.when(same, 0).otherwise(10_000)).alias("start"), (F.col("end") + F.when(same, 0).otherwise(20_000)).alias("end"), (F.col("id") + 500_000).alias("id"))


@register("merged_domains", sql('SELECT * FROM doms UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM doms a WHERE a.chrom = b.chrom AND abs(a.start - b.start) <= 5000 AND abs(a."end" - b."end") <= 5000)', *BINS, "doms", b=_D2))
def merged_domains(spark, d):
    return X.merge_domain_lists(T.domains(spark, d), _second(spark, d))


@register("domain_relations", sql("""SELECT a.id AS parent, b.id AS child FROM u a JOIN u b ON a.chrom = b.chrom AND a.start < b."end" AND b.start < a."end" AND a.id <> b.id WHERE least(a."end", b."end") - greatest(a.start, b.start) >= 0.5 * (b."end" - b.start) AND (a."end" - a.start > b."end" - b.start OR (a."end" - a.start = b."end" - b.start AND a.id < b.id))""", *BINS, "doms", b=_D2, u="SELECT * FROM doms UNION ALL SELECT * FROM b"))
def domain_relations(spark, d):
    return X.domain_relations(T.domains(spark, d).union(_second(spark, d))).drop("chrom")


@register("peaks_per_bin", sql("SELECT chrom, start // 10000 * 10000 AS start, count(*) AS n FROM iv WHERE chrom = 'purchase' GROUP BY 1, 2 HAVING count(*) >= 8", "iv"))
def peaks_per_bin(spark, d):
    return X.peaks_per_bin(T.intervals(spark, d, "purchase"), 10_000, 8)


_CELLS = """SELECT a.id, b.id AS id2, CASE WHEN a.id = b.id THEN 'intra' ELSE 'right' END AS part, value, sample FROM pxs
 JOIN doms a ON a.chrom = bin1 // 1000000 AND bin1 % 1000000 * 10000 >= a.start AND bin1 % 1000000 * 10000 < a."end"
 JOIN doms b ON b.chrom = bin2 // 1000000 AND bin2 % 1000000 * 10000 >= b.start AND bin2 % 1000000 * 10000 < b."end" WHERE b.id - a.id BETWEEN 0 AND 1"""
_DPX = ("mates", "pairs", "pxs", *BINS, "doms")


@register("inter_intra", sql("SELECT id, intra, coalesce(l, 0) AS inter_left, inter_right, round((coalesce(l, 0) + inter_right) / intra, 6) AS ratio FROM (SELECT id, coalesce(sum(value) FILTER (part = 'intra'), 0) AS intra, coalesce(sum(value) FILTER (part = 'right'), 0) AS inter_right FROM c GROUP BY 1) LEFT JOIN (SELECT id2 AS id, sum(value) AS l FROM c WHERE part = 'right' GROUP BY 1) USING (id)", *_DPX, c=_CELLS))
def inter_intra(spark, d):
    return _r(X.inter_intra(T.pixels(spark, d), T.domains(spark, d), T.BIN), "ratio")


_RANK = "SELECT id, part, sample, value, rank() OVER (PARTITION BY id, part ORDER BY value) + (count(*) OVER (PARTITION BY id, part, value) - 1) / 2 AS r FROM v"


@register("differential_domains", sql("SELECT id, part, n1, n2, round((w - n1 * (n1 + n2 + 1) / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12), 6) AS z FROM (SELECT id, part, count(*) FILTER (sample = 0) AS n1, count(*) FILTER (sample = 1) AS n2, sum(r) FILTER (sample = 0) AS w FROM ranked GROUP BY 1, 2) WHERE n1 > 0 AND n2 > 0", *_DPX, c=_CELLS, v="SELECT id, part, sample, value FROM c UNION ALL SELECT id2, 'left', sample, value FROM c WHERE part = 'right'", ranked=_RANK))
def differential_domains(spark, d):
    a, b = T.pixels(spark, d, sample=0), T.pixels(spark, d, sample=1)
    return _r(X.differential_domains(a, b, T.domains(spark, d), T.BIN).drop("p"), "z")


@register("domain_peak_filter", sql("""SELECT a.id, max(b.score) AS score FROM iv a JOIN iv b ON a.chrom = b.chrom AND a.start < b."end" AND b.start < a."end" GROUP BY 1 HAVING max(b.score) > 60""", "iv"))
def domain_peak_filter(spark, d):
    """Every interval against every interval as a peak."""
    from ..operators.intervals import range_join

    iv = T.intervals(spark, d)
    x = range_join(iv.select("chrom", "start", "end", "id"), iv.select("chrom", "start", "end", "score"), 1000)
    return x.groupBy(F.col("l.id").alias("id")).agg(F.max("r.score").alias("score")).where("score > 60")


_RATIO = "SELECT bin1, bin2, value, value / e AS ratio FROM intra JOIN (SELECT d, sum(value) / count(*) AS e FROM intra GROUP BY 1) USING (d) WHERE d BETWEEN 1 AND 30"
_CAND = "SELECT * FROM rt WHERE value >= 10 AND ratio >= 1.2"


def _candidates(spark, d, **more):
    px, bins = _inputs(spark, d)
    return px, X.loop_candidates(px, M.obs_exp(px, bins, "non_zero"), 30, 10, 1.2, **more)


@register("loop_candidates", sql("SELECT bin1, bin2, value, round(ratio, 6) AS ratio FROM c", *PX, "intra", rt=_RATIO, c=_CAND))
def loop_candidates(spark, d):
    return _r(_candidates(spark, d)[1], "ratio")


_LOCAL = "SELECT * FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE abs(a.bin1 - b.bin1) <= 5 AND abs(a.bin2 - b.bin2) <= 5 AND b.value > a.value)"


@register("loop_maxima", sql("SELECT bin1, bin2, value, round(ratio, 6) AS ratio FROM l", *PX, "intra", rt=_RATIO, c=_CAND, l=_LOCAL))
def loop_maxima(spark, d):
    return _r(X.local_maxima(_candidates(spark, d)[1]), "ratio")


@register("loop_tests", sql("SELECT bin1, bin2, n1, n2, round((w - n1 * (n1 + n2 + 1) / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12), 6) AS z FROM (SELECT bin1, bin2, count(*) FILTER (p) AS n1, count(*) FILTER (NOT p) AS n2, sum(r) FILTER (p) AS w FROM k GROUP BY 1, 2)", *PX, "intra", rt=_RATIO, c=_CAND, l=_LOCAL,
    v="SELECT l.bin1, l.bin2, abs(i) <= 2 AND abs(j) <= 2 AS p, coalesce(px.value, 0) AS value FROM l CROSS JOIN (SELECT unnest(range(-5, 6)) AS i) CROSS JOIN (SELECT unnest(range(-5, 6)) AS j) LEFT JOIN px ON px.bin1 = least(l.bin1 + i, l.bin2 + j) AND px.bin2 = greatest(l.bin1 + i, l.bin2 + j)",
    k="SELECT *, rank() OVER (PARTITION BY bin1, bin2 ORDER BY value) + (count(*) OVER (PARTITION BY bin1, bin2, value) - 1) / 2 AS r FROM v"))
def loop_tests(spark, d):
    px, c = _candidates(spark, d)
    return _r(X.loop_tests(px, X.local_maxima(c)).drop("p"), "z")


@register("loops_fitted")
def loops_fitted(spark, d):
    """No SQL: a negative binomial is fitted per distance."""
    return X.local_maxima(_candidates(spark, d, p=0.2)[1])


def _loops(spark, d):
    """A loop of every interval."""
    iv = T.intervals(spark, d)
    return iv.select(F.col("chrom").alias("chrom1"), F.col("start").alias("start1"), (F.col("start") + 1000).alias("end1"), F.col("chrom").alias("chrom2"), (F.col("start") + 20_000).alias("start2"), (F.col("start") + 20_000 + 500 * (1 + F.col("id") % 7)).alias("end2"), "id")


_LOOPS = """SELECT chrom AS chrom1, start AS start1, start + 1000 AS end1, chrom AS chrom2, start + 20000 AS start2, start + 20000 + 500 * (1 + id % 7) AS end2, id FROM iv"""


@register("merged_loops", sql("""SELECT chrom1, start1, end1, chrom2, start2, end2 FROM o l WHERE NOT EXISTS (SELECT 1 FROM o r WHERE l.chrom1 = r.chrom1 AND l.chrom2 = r.chrom2 AND l.start1 - 2000 < r.end1 AND r.start1 < l.end1 + 2000 AND l.start2 - 2000 < r.end2 AND r.start2 - 2000 < l.end2
 AND (r.end2 - r.start2, -r.start1, -r.start2, -r.end1) > (l.end2 - l.start2, -l.start1, -l.start2, -l.end1))""", "iv", loops=_LOOPS, o="SELECT chrom1, start1, end1, chrom2, start2, end2 FROM loops GROUP BY ALL HAVING count(*) = 1"))
def merged_loops(spark, d):
    return X.merge_loops(_loops(spark, d).drop("id"), 2000)


@register("validated_loops", sql("""SELECT id FROM loops l WHERE EXISTS (SELECT 1 FROM pk p WHERE p.chrom = l.chrom1 AND p.start < l.end1 AND l.start1 < p."end") AND EXISTS (SELECT 1 FROM pk p WHERE p.chrom = l.chrom2 AND p.start < l.end2 AND l.start2 < p."end")""", "iv", loops=_LOOPS, pk='SELECT DISTINCT chrom, start // 1000 * 1000 AS start, ("end" // 1000 + 1) * 1000 AS "end" FROM iv WHERE score > 70'))
def validated_loops(spark, d):
    return X.validate_loops(_loops(spark, d), T.intervals(spark, d).where("score > 70"), 1000).select("id")


@register("compartment_eigenvectors")
def eigenvectors(spark, d):
    """No SQL: an eigen decomposition per chromosome, its sign set by the density of reference points."""
    e = X.eigenvectors(*_inputs(spark, d), k=1).select("bin_id", "value")
    n = T.points(spark, d).groupBy(bin_of("chrom", F.col("end") - 1, T.BIN).alias("bin_id")).agg(F.count(F.lit(1)).alias("n"))
    return X.flip_sign(e, n)


@register("track_flip", sql("SELECT bin_id, round(CASE WHEN r < 0 THEN -value ELSE value END, 6) AS value FROM j JOIN (SELECT bin_id // 1000000 AS c, corr(value, n) AS r FROM j GROUP BY 1) ON c = bin_id // 1000000", "points", "track", j="SELECT bin_id, value, coalesce(n, 0) AS n FROM track LEFT JOIN (SELECT chrom * 1000000 + (\"end\" - 1) // 10000 AS bin_id, count(*) AS n FROM points GROUP BY 1) USING (bin_id)"))
def track_flip(spark, d):
    n = T.points(spark, d).groupBy(bin_of("chrom", F.col("end") - 1, T.BIN).alias("bin_id")).agg(F.count(F.lit(1)).alias("n"))
    return _r(X.flip_sign(T.tracks(spark, d), n), "value")


_Q = 10
_QS = "SELECT bin_id, len(list_filter(e, lambda x: x <= value)) AS q FROM track, (SELECT quantile_cont(value, [" + ", ".join(repr(k / 9) for k in range(_Q)) + "]) AS e FROM track)"


@register("compartment_quantiles", sql("SELECT bin_id, q FROM q", "track", q=_QS))
def compartment_quantiles(spark, d):
    return X.quantile_of(T.tracks(spark, d), _Q)


_SADDLE = """SELECT q1, q2, coalesce(s, 0) / cells AS mean, cells FROM (SELECT a.q AS q1, b.q AS q2, count(*) AS cells FROM q a JOIN q b ON a.bin_id // 1000000 = b.bin_id // 1000000 GROUP BY 1, 2) LEFT JOIN
 (SELECT a.q AS q1, b.q AS q2, sum(v) AS s FROM (SELECT bin1, bin2, v FROM oe UNION ALL SELECT bin2, bin1, v FROM oe WHERE bin1 <> bin2) JOIN q a ON a.bin_id = bin1 JOIN q b ON b.bin_id = bin2 GROUP BY 1, 2) USING (q1, q2)"""
_OE = "SELECT bin1, bin2, value / e AS v FROM intra JOIN (SELECT d, sum(value) / count(*) AS e FROM intra GROUP BY 1) USING (d)"


def _saddle(spark, d):
    return X.saddle(M.obs_exp(*_inputs(spark, d), "non_zero"), X.quantile_of(T.tracks(spark, d), _Q))


@register("compartment_saddle", sql("SELECT q1, q2, round(mean, 6) AS mean, cells FROM s", *PX, "intra", "track", q=_QS, oe=_OE, s=_SADDLE))
def compartment_saddle(spark, d):
    return _r(_saddle(spark, d), "mean")


@register("compartment_polarization", sql("SELECT k, round(sum(mean) FILTER ((q1 <= k AND q2 <= k) OR (q1 > 10 - k AND q2 > 10 - k)) / sum(mean) FILTER ((q1 <= k AND q2 > 10 - k) OR (q1 > 10 - k AND q2 <= k)), 6) AS ratio FROM s, (SELECT unnest(range(1, 10)) AS k) GROUP BY 1 HAVING sum(mean) FILTER ((q1 <= k AND q2 > 10 - k) OR (q1 > 10 - k AND q2 <= k)) > 0", *PX, "intra", "track", q=_QS, oe=_OE, s=_SADDLE))
def compartment_polarization(spark, d):
    return _r(X.polarization(_saddle(spark, d), _Q), "ratio")


_XY = "SELECT coalesce(x.value, 0) AS x, coalesce(y.value, 0) AS y FROM (SELECT * FROM o WHERE sample = 0) x FULL JOIN (SELECT * FROM o WHERE sample = 1) y USING (bin1, bin2) WHERE coalesce(x.value, 0) + coalesce(y.value, 0) > 1"
_OFF = "SELECT * FROM pxs WHERE bin1 <> bin2 AND bin1 // 1000000 = bin2 // 1000000"


@register("correlate_pearson", sql("SELECT count(*) AS n, round(corr(ln(1 + x), ln(1 + y)), 6) AS r FROM xy", "mates", "pairs", "pxs", o=_OFF, xy=_XY))
def correlate(spark, d):
    return _r(X.correlation(T.pixels(spark, d, sample=0), T.pixels(spark, d, sample=1), log1p=True), "r")


@register("correlate_spearman", sql("SELECT count(*) AS n, round(corr(a, b), 6) AS r FROM (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS b FROM xy)", "mates", "pairs", "pxs", o=_OFF, xy=_XY))
def correlate_spearman(spark, d):
    return _r(X.correlation(T.pixels(spark, d, sample=0), T.pixels(spark, d, sample=1), method="spearman"), "r")


def _anchors(spark, d):
    return T.points(spark, d).select(bin_of("chrom", "start", T.BIN).alias("bin_id"))


_RP = "SELECT DISTINCT a.bin_id AS bin1, b.bin_id AS bin2 FROM points a JOIN points b ON a.chrom = b.chrom AND b.bin_id - a.bin_id BETWEEN 4 AND 20"
_FIT = "SELECT bin1, bin2 FROM rp JOIN perchrom ON chrom = bin1 // 1000000 WHERE bin1 % 1000000 >= 3 AND bin2 % 1000000 + 3 < n"
_CELL = "SELECT f.bin1, f.bin2, i AS dr, j AS dc, coalesce(px.value, 0) AS value FROM f CROSS JOIN (SELECT unnest(range(-3, 4)) AS i) CROSS JOIN (SELECT unnest(range(-3, 4)) AS j) LEFT JOIN px ON px.bin1 = least(f.bin1 + i, f.bin2 + j) AND px.bin2 = greatest(f.bin1 + i, f.bin2 + j)"
_PILE = {"rp": _RP, "f": _FIT, "w": _CELL, "t": "SELECT bin1, bin2, sum(value) AS t FROM w GROUP BY 1, 2 HAVING sum(value) > 0"}


@register("region_pairs", sql("SELECT bin1, bin2 FROM rp", "points", rp=_RP))
def region_pairs(spark, d):
    return X.region_pairs(_anchors(spark, d), 4, 20)


for _how, _f in (("mean", "avg(value)"), ("median", "median(value)"), ("sum", "sum(value)")):

    @register(f"pile_up_{_how}", sql(f"SELECT dr, dc, round({_f}, 6) AS value FROM w JOIN t USING (bin1, bin2) GROUP BY 1, 2", *PX, *BINS, "points", **_PILE))
    def _pile(spark, d, how=_how):
        px, bins = _inputs(spark, d)
        return _r(X.pile_up(px, X.region_pairs(_anchors(spark, d), 4, 20), bins, 3, how), "value")


@register("pile_up_rotated", sql("SELECT dr + dc AS along, dc - dr AS across, round(avg(value / t), 6) AS value FROM w JOIN t USING (bin1, bin2) GROUP BY dr, dc", *PX, *BINS, "points", **_PILE))
def pile_rotated(spark, d):
    px, bins = _inputs(spark, d)
    return _r(X.rotated(X.pile_up(px, X.region_pairs(_anchors(spark, d), 4, 20), bins, 3, "mean", "total-counts")), "value")


_VP = """SELECT p.id, r AS rel_pos, coalesce(value, 0) AS raw FROM (SELECT DISTINCT id, bin_id, n FROM points JOIN perchrom USING (chrom)) p CROSS JOIN (SELECT unnest(range(-20, 21)) AS r)
 LEFT JOIN px ON bin1 = least(bin_id, bin_id + r) AND bin2 = greatest(bin_id, bin_id + r) WHERE bin_id % 1000000 + r BETWEEN 0 AND n - 1"""
_SM = "SELECT *, avg(raw) OVER (PARTITION BY id ORDER BY rel_pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth FROM vp"
_REL = "SELECT *, smooth / sum(smooth) FILTER (abs(rel_pos) <= 15) OVER (PARTITION BY id) AS relative FROM sm"
_V = (*PX, *BINS, "points")


def _profile(spark, d, sample=None):
    bins = T.fixed_bins(spark, d)
    p = T.points(spark, d).select("id", bin_of("chrom", "start", T.BIN).alias("bin_id"))
    return X.viewpoints(T.pixels(spark, d, sample=sample), p, bins, 20)


@register("viewpoint_profile", sql("SELECT id, rel_pos, raw, round(smooth, 6) AS smooth, round(relative, 6) AS relative FROM rel", *_V, vp=_VP, sm=_SM, rel=_REL))
def viewpoint_profile(spark, d):
    return _r(X.relative(X.smooth(_profile(spark, d)), 15), "smooth", "relative")


@register("viewpoint_quality", sql("SELECT id, round(count(*) FILTER (raw > 0) / count(*), 6) AS sparsity, count(*) FILTER (raw > 0) / count(*) > 0.9 AS ok FROM vp GROUP BY 1", *_V, vp=_VP))
def viewpoint_quality(spark, d):
    return _r(X.point_quality(_profile(spark, d), 0.9), "sparsity")


@register("viewpoint_xfold", sql("SELECT id, rel_pos, round(relative / (avg(relative) OVER (PARTITION BY rel_pos)), 6) AS x_fold FROM rel", *_V, vp=_VP, sm=_SM, rel=_REL))
def viewpoint_xfold(spark, d):
    p = X.relative(X.smooth(_profile(spark, d)), 15)
    b = p.groupBy("rel_pos").agg(F.avg("relative").alias("mean"))
    return p.join(F.broadcast(b), "rel_pos").select("id", "rel_pos", rounded(F.col("relative") / F.col("mean"), 6).alias("x_fold"))  # a row per position


@register("viewpoint_runs", sql("SELECT id, min(rel_pos) AS start, max(rel_pos) AS \"end\", arg_max(rel_pos, (raw, -rel_pos)) AS rel_pos, sum(raw) AS raw FROM (SELECT *, sum(n) OVER (PARTITION BY id ORDER BY rel_pos) AS g FROM (SELECT *, CASE WHEN rel_pos - lag(rel_pos) OVER (PARTITION BY id ORDER BY rel_pos) <= 1 THEN 0 ELSE 1 END AS n FROM vp WHERE raw >= 8)) GROUP BY id, g", *_V, vp=_VP))
def viewpoint_runs(spark, d):
    return X.significant_runs(_profile(spark, d).where("raw >= 8"))


@register("viewpoint_background")
def viewpoint_background(spark, d):
    """No SQL: a negative binomial per relative position, then tails of all positions."""
    from ..functions.stats import nb_tail

    p = X.relative(X.smooth(_profile(spark, d)), 15)
    b = X.background(p)
    return p.join(F.broadcast(b), "rel_pos").withColumn("p", F.coalesce(nb_tail("smooth", "size", "prob"), F.lit(1.0))).withColumn("x_fold", F.col("relative") / F.col("mean"))


def _diff_sql(s):
    return f"SELECT id, rel_pos, raw, sum(raw) OVER (PARTITION BY id) AS s FROM (SELECT * FROM ({_VP.replace('LEFT JOIN px ON', f'LEFT JOIN (SELECT * FROM pxs WHERE sample = {s}) px ON')}))"


@register("viewpoint_differential", sql("SELECT id, rel_pos, a.s AS s1, a.raw AS x1, b.s AS s2, b.raw AS x2, round((a.s + a.raw + b.s + b.raw) * power(a.s * b.raw - a.raw * b.s, 2) / nullif((a.s + a.raw) * (b.s + b.raw) * (a.s + b.s) * (a.raw + b.raw), 0), 6) AS stat FROM a JOIN b USING (id, rel_pos)", "mates", "pairs", "pxs", *BINS, "points", a=_diff_sql(0), b=_diff_sql(1)))
def viewpoint_differential(spark, d):
    return _r(X.differential(_profile(spark, d, 0), _profile(spark, d, 1), "chi2").drop("p", "rejected"), "stat")


@register("viewpoint_fisher")
def viewpoint_fisher(spark, d):
    """No SQL: exact tests by log-gamma."""
    return X.differential(_profile(spark, d, 0), _profile(spark, d, 1), "fisher").drop("stat")


_BF = "SELECT bin_id AS bin1, bin_id AS bin2 FROM bins JOIN perchrom USING (chrom) WHERE bin_id % 1000000 >= 3 AND bin_id % 1000000 + 3 < n"


@register("boundary_features", sql("SELECT bin1 AS bin_id, array_to_string(list(value::BIGINT ORDER BY dr, dc), ',') AS features FROM w WHERE dr <= dc GROUP BY 1", *PX, *BINS, f=_BF, w=_CELL))
def boundary_features(spark, d):
    x = X.boundary_features(*_inputs(spark, d), 3)
    return x.select("bin_id", F.array_join(F.transform("features", lambda v: v.cast("bigint").cast("string")), ",").alias("features"))


@register("boundary_classifier")
def boundary_classifier(spark, d):
    """No SQL: a forest learns the borders of domains."""
    px, bins = _inputs(spark, d)
    f = cut(X.boundary_features(px, bins, 3))  # made once, read by each pass of the forest
    labels = T.domains(spark, d).select(bin_of("chrom", "start", T.BIN).alias("bin_id"))
    return X.predict_boundaries(X.train_boundaries(f, labels), f)
