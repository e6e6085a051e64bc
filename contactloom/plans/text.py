"""Round trips through the text formats: what is written and read again are the rows that the statement has."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..frames import rounded
from ..operators import matrix as M
from ..operators import pairs as P
from ..registry import register
from ..sources import tables as T
from ..sources import text as X
from .base import BINS, PX, sql

_NAMED = "'chr' || chrom AS chrom"


def _points(spark, d):
    return T.points(spark, d).withColumn("chrom", F.concat(F.lit("chr"), F.col("chrom").cast("string")))


def _size_text(spark, d):
    return T.chrom_sizes(spark, d).select(F.concat(F.lit("chr"), F.col("chrom").cast("string")).alias("chrom"), "size")


@register("text_chrom_sizes", sql(f"SELECT {_NAMED}, size FROM sizes", "sizes"))
def chrom_sizes(spark, d):
    return X.read_chrom_sizes(spark, X.write_fields(_size_text(spark, d), X.new_path(spark)))


@register("text_bed12", sql(f"""SELECT {_NAMED}, start, "end", gene AS name, (id % 7)::DOUBLE AS score, '+' AS strand, start AS thick_start, "end" AS thick_end, '0,0,0' AS rgb, 2 AS block_count, '400,' || 300 + id % 5 AS sizes, '0,600' AS starts FROM points""", "points"))
def bed12(spark, d):
    x = _points(spark, d).select(
        "chrom", "start", "end", F.col("gene").alias("name"), (F.col("id") % 7).cast("double").alias("score"), F.lit("+").alias("strand"), F.col("start").alias("s"), F.col("end").alias("e"), F.lit("0,0,0").alias("rgb"),
        F.lit(2).alias("n"), F.array(F.lit(400), (300 + F.col("id") % 5).cast("int")).alias("sizes"), F.array(F.lit(0), F.lit(600)).alias("starts"),
    )
    got = X.read_bed(spark, X.write_fields(x, X.new_path(spark), "track name=points"), 12)
    return got.withColumns({"sizes": F.array_join("block_sizes", ","), "starts": F.array_join("block_starts", ",")}).drop("block_sizes", "block_starts")


@register("text_bed3_region", sql(f"""SELECT {_NAMED}, start, "end" FROM points WHERE chrom = 2 AND start < 90000 AND "end" > 20000""", "points"))
def bed3_region(spark, d):
    path = X.write_fields(_points(spark, d).select("chrom", "start", "end"), X.new_path(spark))
    return X.in_region(X.read_bed(spark, path, 3), "chr2", 20_000, 90_000)


@register("text_targets", sql(f"""SELECT gene, 'chr' || chrom AS chrom, array_to_string(list(start ORDER BY start, "end"), ',') AS starts, array_to_string(list("end" ORDER BY start, "end"), ',') AS ends FROM (SELECT chrom, start, "end", 'g' || id % 9 AS gene FROM points) GROUP BY 1, chrom""", "points"))
def targets(spark, d):
    x = _points(spark, d).select("chrom", "start", "end", F.concat(F.lit("g"), (F.col("id") % 9).cast("string")).alias("name"))
    return X.read_targets(spark, X.write_fields(x, X.new_path(spark))).withColumns({c: F.array_join(c, ",") for c in ("starts", "ends")})


@register("text_known_names", sql("""SELECT chrom::VARCHAR AS chrom, start, id FROM points WHERE chrom < 5""", "points"))
def known_names(spark, d):
    """Intervals named with and without the prefix, against sizes without it and without the fifth chromosome."""
    bed = T.points(spark, d).select(F.when(F.col("id") % 2 == 0, F.concat(F.lit("chr"), F.col("chrom").cast("string"))).otherwise(F.col("chrom").cast("string")).alias("chrom"), "start", "id")
    return X.known_names(bed, T.chrom_sizes(spark, d).where("chrom < 5").select(F.col("chrom").cast("string").alias("chrom")))


@register("text_bed_faults", sql('SELECT id AS row FROM (SELECT id, start, CASE WHEN id % 11 = 0 THEN start ELSE "end" END AS e, lag(start) OVER (PARTITION BY chrom ORDER BY id) AS b FROM iv) WHERE e <= start OR b > start', "iv"))
def bed_faults(spark, d):
    x = T.intervals(spark, d).select("chrom", "start", F.when(F.col("id") % 11 == 0, F.col("start")).otherwise(F.col("end")).alias("end"), F.col("id").alias("row"))
    return X.bed_faults(x).select("row")


@register("text_domains", sql(f"""SELECT {_NAMED}, start, "end", 'ID_0.01_' || id AS name, (id % 3)::DOUBLE AS score, '.' AS strand FROM doms""", *BINS, "doms"))
def domains(spark, d):
    x = T.domains(spark, d).select(F.concat(F.lit("chr"), F.col("chrom").cast("string")).alias("chrom"), "start", "end", (F.col("id") % 3).cast("double").alias("score"), F.col("id").alias("k"))
    return X.read_domains(spark, X.write_domains(x, X.new_path(spark)))


@register("text_loops", sql("SELECT chrom AS chrom1, start AS start1, start + 1000 AS end1, chrom AS chrom2, start + 20000 AS start2, start + 21000 AS end2, score AS p FROM iv", "iv"))
def loops(spark, d):
    iv = T.intervals(spark, d)
    named = F.concat(F.lit("chr"), F.col("chrom"))
    x = iv.select(named.alias("c1"), F.col("start").alias("s1"), (F.col("start") + 1000).alias("e1"), named.alias("c2"), (F.col("start") + 20_000).alias("s2"), (F.col("start") + 21_000).alias("e2"), F.col("score").alias("p"))
    return X.read_loops(spark, X.write_fields(x, X.new_path(spark)), "remove")


@register("text_peaks", sql("""SELECT 'chr' || chrom AS chrom, start, "end", score AS signal, 0.5::DOUBLE AS p, (id % 4)::DOUBLE AS q FROM iv WHERE chrom = 'purchase'""", "iv"))
def peaks(spark, d):
    x = T.intervals(spark, d, "purchase").select("chrom", "start", "end", F.col("id").alias("name"), F.lit(0).alias("score"), F.lit(".").alias("strand"), F.col("score").alias("signal"), F.lit(0.5).alias("p"), (F.col("id") % 4).cast("double").alias("q"), F.lit(10).alias("peak"))
    return X.read_peaks(spark, X.write_fields(x, X.new_path(spark)), "add")


@register("text_fasta", "SELECT 'p' || p_partkey AS chrom, replace(p_name, ' ', '') || 'ACGT' AS seq FROM part")
def fasta(spark, d):
    p = T.table(spark, d, "part")
    rows = p.select(F.concat(F.lit(">p"), F.col("p_partkey").cast("string"), F.lit(" a part\n"), "p_name", F.lit("\nACGT")).alias("value"))
    path = X.new_path(spark)
    rows.write.text(path)
    return X.read_fasta(spark, path)


@register("text_points", sql(f"""SELECT {_NAMED}, start, CASE WHEN id % 2 = 0 THEN start ELSE "end" END AS "end", 'g' || id AS gene FROM points""", "points"))
def points(spark, d):
    gene = F.concat(F.lit("g"), F.col("id").cast("string"))
    short = F.concat_ws("\t", "chrom", F.col("start").cast("string"), gene)
    long = F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), gene)
    path = X.new_path(spark)
    _points(spark, d).select(F.when(F.col("id") % 2 == 0, short).otherwise(long).alias("value")).write.text(path)
    return X.read_points(spark, path)


@register("text_background", "SELECT r AS rel_pos, (200 + greatest(-50, least(50, r // 1000)))::DOUBLE AS size, 0.25::DOUBLE AS prob, 7.0::DOUBLE AS most, 0.5::DOUBLE AS mean FROM (SELECT unnest(range(-80000, 81000, 1000)) AS r)")
def background(spark, d):
    x = spark.range(-50, 51).select((F.col("id") * 1000).alias("rel_pos"), (200 + F.col("id")).cast("double").alias("size"), F.lit(0.25).alias("prob"), F.lit(7.0).alias("most"), F.lit(0.5).alias("mean"))
    return X.read_background(spark, X.write_fields(x, X.new_path(spark), "# relative position"), 80_000, 1000)


@register("text_bedgraph_over_bins", sql("""SELECT bin_id, round(sum(value * o) / sum(o), 6) AS value FROM (SELECT b.bin_id, p.id % 10 AS value, least(b."end", p."end" + 7000) - greatest(b.start, p.start) AS o FROM bins b JOIN points p ON b.chrom = p.chrom AND p.start < b."end" AND b.start < p."end" + 7000) GROUP BY 1""", *BINS, "points"))
def bedgraph(spark, d):
    x = _points(spark, d).select("chrom", "start", (F.col("end") + 7000).alias("end"), (F.col("id") % 10).cast("double").alias("value"))
    track = X.read_bedgraph(spark, X.write_fields(x, X.new_path(spark)))
    bins = T.fixed_bins(spark, d).withColumn("chrom", F.concat(F.lit("chr"), F.col("chrom").cast("string")))
    return X.track_over_bins(track, bins).select("bin_id", rounded("value", 6).alias("value"))


@register("text_thresholds", "SELECT r AS rel_pos, 0.5::DOUBLE AS value FROM (SELECT unnest(range(-20000, 21000, 1000)) AS r)")
def thresholds(spark, d):
    from ..operators.bins import threshold_table

    return X.read_thresholds(spark, X.write_fields(threshold_table(spark, 20_000, 20_000, 1000, 0.5), X.new_path(spark), "# made"))


@register("text_bedgraph_matrix", sql("""SELECT 'chr' || chrom AS chrom, start, "end", (bin_id % 5)::DOUBLE AS first, (bin_id % 3)::DOUBLE AS last, 4 AS step, 30000 AS "minDepth" FROM bins""", "sizes", "bins"))
def bedgraph_matrix(spark, d):
    b = T.fixed_bins(spark, d)
    x = b.select(F.concat(F.lit("chr"), F.col("chrom").cast("string")).alias("chrom"), "start", "end", F.array((F.col("bin_id") % 5).cast("double"), F.lit(1.0), (F.col("bin_id") % 3).cast("double")).alias("scores"))
    rows, head = X.read_bedgraph_matrix(spark, X.write_bedgraph_matrix(x, X.new_path(spark), 4, 30_000, 100_000, T.BIN))
    return rows.crossJoin(F.broadcast(head)).select("chrom", "start", "end", F.col("scores")[0].alias("first"), F.col("scores")[2].alias("last"), "step", "minDepth")


@register("text_qc_log", sql("SELECT 'run' AS file, unnest(['sequenced', 'unmapped']) AS key, unnest([count(*), count(*) FILTER (q = 'one mate unmapped')]) AS value FROM classed", "mates", "pairs", "classed"))
def qc_log(spark, d):
    return X.read_qc_logs(spark, X.write_qc_log(P.qc(T.pairs(spark, d)), X.new_path(spark), "run")).where("key IN ('sequenced', 'unmapped')")


_CELL_TEXT = sql("SELECT (bin1 // 1000000)::VARCHAR AS chrom1, bin1 % 1000000 * 10000 AS start1, (bin2 // 1000000)::VARCHAR AS chrom2, bin2 % 1000000 * 10000 AS start2, value FROM px", *PX)


@register("text_hicpro", _CELL_TEXT)
def hicpro(spark, d):
    return X.read_hicpro(spark, *X.write_hicpro(T.pixels(spark, d), T.fixed_bins(spark, d), X.new_path(spark)))


@register("text_homer", _CELL_TEXT)
def homer(spark, d):
    return X.read_homer(spark, X.write_homer(T.pixels(spark, d), T.fixed_bins(spark, d), X.new_path(spark)))


@register("text_ginteractions", sql("SELECT bin1, bin2, value FROM px", *PX))
def ginteractions(spark, d):
    return X.read_2d_text(spark, X.write_ginteractions(T.pixels(spark, d), T.fixed_bins(spark, d), X.new_path(spark)), T.BIN)


@register("text_sam_pairs", sql("SELECT read_id::VARCHAR AS read_id, chrom1::VARCHAR AS chrom1, pos1, mapq1, rev1, chrom2::VARCHAR AS chrom2, pos2, mapq2, rev2 FROM pairs", "mates", "pairs"))
def sam_pairs(spark, d):
    """Pairs written as two alignment files, with a secondary and a later supplementary record each, and read back."""
    p = T.pairs(spark, d)
    paths = []
    for k in (1, 2):
        flag = F.col(f"flag{k}") + F.when(F.col(f"rev{k}"), 16).otherwise(0)
        rows = p.select("read_id", F.col(f"chrom{k}").alias("chrom"), F.col(f"pos{k}").alias("pos"), F.col(f"mapq{k}").alias("mapq"), F.explode(F.array(
            F.struct(flag.alias("flag"), F.lit("36M").alias("cigar")), F.struct((flag + 256).alias("flag"), F.lit("36M").alias("cigar")), F.struct((flag + 2048).alias("flag"), F.lit("9S18M9S").alias("cigar")))).alias("r"))
        other = F.when(F.col("r.flag") >= 2048, 7).otherwise(0)
        sam = rows.select("read_id", "r.flag", "chrom", (F.col("pos") + 1 + other).alias("pos"), "mapq", "r.cigar", F.lit("*").alias("n"), F.lit(0).alias("m"), F.lit(0).alias("t"), F.lit("A" * 36).alias("seq"), F.lit("*").alias("q"))
        paths.append(X.write_fields(sam, X.new_path(spark), "@HD\tVN:1.6", compression="gzip"))
    x = X.paired(*[X.read_sam(spark, at) for at in paths])
    return x.select("read_id", *[f"{c}{k}" for k in (1, 2) for c in ("chrom", "pos", "mapq", "rev")])


@register("parts_multi_resolution", sql("SELECT 20000 AS resolution, count(*) AS n, sum(value) AS total FROM (SELECT least(a, b), greatest(a, b), count(*) AS value FROM (SELECT chrom1 * 1000000 + (pos1 + 18) // 20000 AS a, chrom2 * 1000000 + (pos2 + 18) // 20000 AS b FROM pairs) GROUP BY ALL)", "mates", "pairs"))
def parts_multi_resolution(spark, d):
    """A container with a folder per resolution, of which one is read."""
    every = None
    for size in (10_000, 20_000):
        x = P.contact_matrix(T.pairs(spark, d), size).withColumn("resolution", F.lit(size))
        every = x if every is None else every.union(x)
    x = spark.read.parquet(X.write_parts(every, X.new_path(spark), "resolution")).where("resolution = 20000")
    return x.groupBy("resolution").agg(F.count(F.lit(1)).alias("n"), F.sum("value").cast("bigint").alias("total"))


@register("parts_pairs", sql("SELECT sample, count(*) AS n, sum((CASE WHEN rev1 THEN 16 ELSE 0 END) + 65) AS flags FROM accepted GROUP BY 1", "mates", "pairs", "classed", "accepted"))
def parts_pairs(spark, d):
    """Surviving pairs with mate flags (paired, first, second), a folder per sample."""
    x = P.reflagged(P.accepted(T.pairs(spark, d)))
    got = spark.read.parquet(X.write_parts(x, X.new_path(spark), "sample"))
    return got.groupBy("sample").agg(F.count(F.lit(1)).alias("n"), F.sum("flag1").alias("flags"))


@register("converted_matrix", sql("SELECT bin1, bin2, round(round(value / (x.w * y.w)), 6) AS value FROM px JOIN w x ON x.b = bin1 JOIN w y ON y.b = bin2 WHERE bin1 // 1000000 = 2 AND bin2 // 1000000 = 2", *PX, "full_px", w="SELECT bin1 AS b, 1 / (1 + bin1 % 3) AS w FROM full_px GROUP BY 1"))
def converted_matrix(spark, d):
    """One chromosome with its correction applied by division and whole numbers enforced."""
    px = T.pixels(spark, d)
    w = M.marginals(px).select("bin_id", (1 / (1 + F.col("bin_id") % 3)).alias("weight"))
    return M.converted(px, w, divide=True, integers=True, chrom=2)
