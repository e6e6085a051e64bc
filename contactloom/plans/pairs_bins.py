"""Queries over read pairs, bins and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bins as B
from ..operators import intervals as I
from ..operators import pairs as P
from ..registry import register
from ..sources import tables as T
from .base import sql

PAIRS = ("mates", "pairs", "classed")


@register("pairs_contact_matrix", sql("SELECT least(a, b) AS bin1, greatest(a, b) AS bin2, count(*)::DOUBLE AS value FROM (SELECT chrom1 * 1000000 + (pos1 + 18) // 10000 AS a, chrom2 * 1000000 + (pos2 + 18) // 10000 AS b FROM accepted) GROUP BY ALL", *PAIRS, "accepted"))
def contact_matrix(spark, d):
    return P.contact_matrix(P.accepted(T.pairs(spark, d)), T.BIN)


@register("pairs_multi_resolution", sql(" UNION ALL ".join(f"SELECT {s}::INT AS resolution, least(a, b) AS bin1, greatest(a, b) AS bin2, count(*)::DOUBLE AS value FROM (SELECT chrom1 * 1000000 + (pos1 + 18) // {s} AS a, chrom2 * 1000000 + (pos2 + 18) // {s} AS b FROM accepted) GROUP BY ALL" for s in (10000, 20000, 50000)), *PAIRS, "accepted"))
def multi_resolution(spark, d):
    p = P.accepted(T.pairs(spark, d)).withColumn("resolution", F.explode(F.array(*[F.lit(s) for s in (10_000, 20_000, 50_000)])))
    at = lambda k: (F.col(f"chrom{k}") * 1_000_000 + F.floor((F.col(f"pos{k}") + 18) / F.col("resolution"))).cast("bigint")
    return p.groupBy("resolution", F.least(at(1), at(2)).alias("bin1"), F.greatest(at(1), at(2)).alias("bin2")).agg(F.count(F.lit(1)).cast("double").alias("value"))


@register("pairs_classes", sql("SELECT coalesce(q, 'usable') AS class, o AS orientation, len, count(*) AS n FROM classed GROUP BY ALL", *PAIRS))
def classes(spark, d):
    p = T.pairs(spark, d)
    return p.groupBy(F.coalesce(P.quality_class(), F.lit("usable")).alias("class"), P.orientation().alias("orientation"), P.length_class().alias("len")).agg(F.count(F.lit(1)).alias("n"))


_O = ", ".join(f"count(*) FILTER (o = '{o}') AS {o.replace('-', '_').replace(' ', '_')}" for o in ("inward", "outward", "same-strand-left", "same-strand-right", "different chromosome"))


@register("pairs_qc", sql(f"""SELECT *, sequenced - unmapped - not_unique - low_quality AS usable, sequenced - unmapped - not_unique - low_quality - accepted AS duplicates, round(accepted / sequenced, 6) AS accepted_share
FROM (SELECT count(*) AS sequenced, count(*) FILTER (q = 'one mate unmapped') AS unmapped, count(*) FILTER (q = 'one mate not unique') AS not_unique, count(*) FILTER (q = 'one mate low quality') AS low_quality FROM classed),
(SELECT count(*) AS accepted, count(*) FILTER (o = 'outward' AND abs(pos1 - pos2) < 25000) AS self_circles, {_O}, count(*) FILTER (len = 'short') AS short_range, count(*) FILTER (len = 'long') AS long_range FROM accepted)""", *PAIRS, "accepted"))
def qc(spark, d):
    return P.qc(T.pairs(spark, d))


@register("pairs_duplicates", sql("SELECT sample, count(*) AS pairs, count(DISTINCT (least(chrom1, chrom2), greatest(chrom1, chrom2), least(pos1, pos2), greatest(pos1, pos2))) AS kept FROM classed WHERE q IS NULL GROUP BY 1", *PAIRS))
def duplicates(spark, d):
    p = T.pairs(spark, d).where(P.quality_class().isNull())
    n = p.groupBy("sample").agg(F.count(F.lit(1)).alias("pairs"))
    return n.join(P.deduplicate(p, ("sample",)).groupBy("sample").agg(F.count(F.lit(1)).alias("kept")), "sample")


@register("pairs_fragments", sql("""SELECT coalesce(f, 'none') AS fragment, count(*) AS n FROM (SELECT CASE WHEN o = 'inward' AND abs(pos1 - pos2) < 30000 THEN
 CASE WHEN EXISTS (SELECT 1 FROM points s WHERE s.chrom = p.chrom1 AND s.start < greatest(pos1, pos2) + 1 AND s.start + 6 > least(pos1, pos2)) THEN 'self ligation' ELSE 'same fragment' END END AS f FROM accepted p) GROUP BY 1""", *PAIRS, "accepted", "points"))
def fragments(spark, d):
    sites = T.points(spark, d).select("chrom", "start", (F.col("start") + 6).alias("end"))
    x = P.fragment_class(P.accepted(T.pairs(spark, d)), sites, library=30_000)
    return x.groupBy(F.coalesce("fragment", F.lit("none")).alias("fragment")).agg(F.count(F.lit(1)).alias("n"))


@register("pairs_micro_c", sql("SELECT least(a, b) AS bin1, greatest(a, b) AS bin2, count(*)::DOUBLE AS value FROM (SELECT chrom1 * 1000000 + (pos1 + 18) // 10000 AS a, chrom2 * 1000000 + (pos2 + 18) // 10000 AS b FROM accepted WHERE NOT (o = 'inward' AND abs(pos1 - pos2) < 1000)) GROUP BY ALL", *PAIRS, "accepted"))
def micro_c(spark, d):
    p = P.fragment_class(P.accepted(T.pairs(spark, d)), None).where("fragment IS NULL")
    return P.contact_matrix(p, T.BIN)


@register("pairs_region", sql("SELECT least(a, b) AS bin1, greatest(a, b) AS bin2, count(*)::DOUBLE AS value FROM (SELECT chrom1 * 1000000 + (pos1 + 18) // 10000 AS a, chrom2 * 1000000 + (pos2 + 18) // 10000 AS b FROM accepted WHERE chrom1 = 2 AND chrom2 = 2 AND pos1 BETWEEN 50000 AND 199999 AND pos2 BETWEEN 50000 AND 199999) GROUP BY ALL", *PAIRS, "accepted"))
def region(spark, d):
    p = P.accepted(T.pairs(spark, d)).where("chrom1 = 2 AND chrom2 = 2 AND pos1 BETWEEN 50000 AND 199999 AND pos2 BETWEEN 50000 AND 199999")
    return P.contact_matrix(p, T.BIN)


@register("pairs_coverage", sql("SELECT c * 1000000 + s * 10 // 10000 AS bin_id, max(w) AS extra FROM (SELECT c, s, count(*) AS w FROM (SELECT c, unnest(range(p // 10, (p + 35) // 10 + 1)) AS s FROM (SELECT chrom1 AS c, pos1 AS p FROM accepted UNION ALL SELECT chrom2, pos2 FROM accepted)) GROUP BY ALL) GROUP BY ALL", *PAIRS, "accepted"))
def coverage(spark, d):
    return P.coverage(P.accepted(T.pairs(spark, d)), T.BIN)


@register("bins_fixed", sql('SELECT bin_id, chrom, start, "end" FROM bins', "sizes", "bins"))
def fixed(spark, d):
    return T.fixed_bins(spark, d)


_ISLES = """SELECT chrom, min(start) AS s, max("end") AS e FROM (SELECT *, sum(n) OVER (PARTITION BY chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS i FROM
 (SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 0 ELSE 1 END AS n FROM {t})) GROUP BY chrom, i"""


@register("bins_restriction", sql("""SELECT * FROM (SELECT chrom, CASE WHEN lag(e) OVER w > s THEN (lag(e) OVER w + s) // 2 ELSE s END AS start, CASE WHEN lead(s) OVER w < e THEN (lead(s) OVER w + e) // 2 ELSE e END AS "end" FROM wide WINDOW w AS (PARTITION BY chrom ORDER BY s)) WHERE "end" - start >= 300""",
    "sizes", "points", m=_ISLES.format(gap=300, t="points"), wide="SELECT chrom, greatest(0, s - 2000) AS s, least(size, e + 2000) AS e FROM m JOIN sizes USING (chrom)"))
def restriction(spark, d):
    return B.restriction_bins(T.points(spark, d), T.chrom_sizes(spark, d), 300, 2000)


@register("bins_enlarged", sql("""SELECT chrom, CASE WHEN lag(e) OVER w IS NULL THEN 0 ELSE (lag(e) OVER w + s) // 2 END AS start, CASE WHEN lead(s) OVER w IS NULL THEN size ELSE (e + lead(s) OVER w) // 2 END AS "end" FROM m JOIN sizes USING (chrom) WINDOW w AS (PARTITION BY chrom ORDER BY s)""", "sizes", "points", m=_ISLES.format(gap=0, t="points")))
def enlarged(spark, d):
    return B.enlarge(I.merge(T.points(spark, d)), T.chrom_sizes(spark, d))


@register("bins_units", sql("""SELECT bin_id, coalesce(u::VARCHAR, '_ignore_' || bin_id) AS unit, start - coalesce(s, start) AS unit_start FROM bins LEFT JOIN (SELECT bin_id, min(u) AS u, min(s) AS s FROM (SELECT b.bin_id, d.id AS u, d.start AS s FROM bins b JOIN doms d ON b.chrom = d.chrom AND b.start < d."end" AND d.start < b."end") GROUP BY 1) USING (bin_id)""", "sizes", "bins", "doms"))
def units(spark, d):
    return B.units(T.fixed_bins(spark, d), T.domains(spark, d))


@register("bins_snapped", sql('SELECT DISTINCT chrom, start // 5000 * 5000 AS start, ("end" // 5000 + 1) * 5000 AS "end" FROM iv', "iv"))
def snapped(spark, d):
    return I.snap(T.intervals(spark, d), 5000)


@register("threshold_table", "SELECT r AS rel_pos, 0.5::DOUBLE AS value FROM (SELECT unnest(range(-200000, 201000, 1000)) AS r)")
def thresholds(spark, d):
    return B.threshold_table(spark, 200_000, 200_000, 1000, 0.5)


@register("window_list", "WITH RECURSIVE w AS (SELECT 0 AS k, 20000 AS w UNION ALL SELECT k + 1, 20000 + floor(10000 * (k + 1) ** 1.5)::INT FROM w WHERE 20000 + floor(10000 * (k + 1) ** 1.5)::INT <= 200000) SELECT w::BIGINT AS w FROM w")
def window_list(spark, d):
    return spark.createDataFrame([(w,) for w in B.windows(20_000, 200_000, 10_000)], "w bigint")


@register("restriction_sites")
def restriction_sites(spark, d):
    """No SQL: a text is searched for overlapping patterns of both strands."""
    seq = T.table(spark, d, "documents").select(F.col("doc_id").alias("chrom"), F.regexp_replace(F.upper(F.coalesce("text", F.lit(""))), "[^ACGT]", "").alias("seq"))
    return B.restriction_sites(seq, ["GATC", "CG.AG"])


@register("intervals_count", sql("""SELECT a.chrom, a.start, a."end", a.id, count(b.id) AS n FROM iv a LEFT JOIN (SELECT * FROM iv WHERE score > 50) b ON a.chrom = b.chrom AND a.start < b."end" AND b.start < a."end" GROUP BY ALL""", "iv"))
def interval_count(spark, d):
    iv = T.intervals(spark, d)
    return I.overlap_count(iv.select("chrom", "start", "end", "id"), iv.where("score > 50"))


@register("intervals_pairs", sql("""SELECT a.id AS id1, b.id AS id2 FROM iv a JOIN iv b ON a.chrom = b.chrom AND a.start < b."end" AND b.start < a."end" WHERE a.id < b.id""", "iv"))
def interval_pairs(spark, d):
    iv = T.intervals(spark, d).select("chrom", "start", "end", "id")
    return I.range_join(iv, iv, 1000).where("l.id < r.id").select(F.col("l.id").alias("id1"), F.col("r.id").alias("id2"))


@register("intervals_merged", sql('SELECT chrom, s AS start, e AS "end" FROM m', "iv", m=_ISLES.format(gap=100, t="iv")))
def interval_merge(spark, d):
    return I.merge(T.intervals(spark, d), 100).select("chrom", "start", "end")


@register("intervals_first_target", sql("""SELECT a.id, min(b.start) AS t_start, arg_min(b."end", (b.start, b."end")) AS t_end FROM iv a JOIN (SELECT * FROM iv WHERE score > 80) b ON a.chrom = b.chrom AND a.start < b."end" AND b.start < a."end" GROUP BY 1""", "iv"))
def interval_first(spark, d):
    iv = T.intervals(spark, d)
    return I.first_target(iv.select("chrom", "start", "end", "id"), iv.where("score > 80").select("chrom", "start", "end")).select("id", "t_start", "t_end")


@register("intervals_unsupported", sql("""SELECT a.id FROM iv a WHERE NOT EXISTS (SELECT 1 FROM iv b WHERE b.chrom = a.chrom AND b.score > 90 AND a.start < b."end" AND b.start < a."end")""", "iv"))
def interval_anti(spark, d):
    iv = T.intervals(spark, d).select("chrom", "start", "end", "id", "score")
    return iv.join(I.semi(iv, iv.where("score > 90")).select("id"), "id", "left_anti").select("id")


@register("overlapping_bins", sql("""SELECT p.id, b.bin_id FROM points p JOIN bins b ON p.chrom = b.chrom AND p.start < b."end" AND b.start < p."end" """, "sizes", "bins", "points"))
def overlapping_bins(spark, d):
    return I.range_join(T.points(spark, d), T.fixed_bins(spark, d)).select(F.col("l.id").alias("id"), F.col("r.bin_id").alias("bin_id"))


