"""Text formats of the domain, read and written by Spark: one row a line, nothing inferred.

Readers take a path and give typed columns; lines that are blank or start with ``#``,
``track`` or ``browser`` are no rows. Fields that do not parse are NULL. Compressed files
are opened by their extension. Writers take a frame and a path and give the path.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..frames import STRIDE, shared, small

BED = ("chrom string", "start bigint", "end bigint", "name string", "score double", "strand string", "thick_start bigint", "thick_end bigint", "rgb string",
       "block_count int", "block_sizes array<int>", "block_starts array<int>")
LOOP = ("chrom1 string", "start1 bigint", "end1 bigint", "chrom2 string", "start2 bigint", "end2 bigint", "p double")
PEAK = ("chrom string", "start bigint", "end bigint", "name string", "score int", "strand string", "signal double", "p double", "q double", "peak int")
BEDGRAPH = ("chrom string", "start bigint", "end bigint", "value double")
SAM = ("read_id string", "flag int", "chrom string", "pos bigint", "mapq int", "cigar string", "chrom_next string", "pos_next bigint", "template bigint", "seq string", "qual string")


def new_path(spark: SparkSession) -> str:
    """A path of its own in the folder all executors share."""
    return f"{shared(spark)}/text-{uuid.uuid4().hex}"


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(~F.col("value").rlike(r"^\s*$|^#|^track|^browser"))


def fields(rows: DataFrame, schema: tuple[str, ...], sep: str = "\t") -> DataFrame:
    """The columns of ``schema`` from the fields of each line; absent ones are NULL, lists are split at commas."""
    x = F.split("value", sep)

    def column(k: int, spec: str) -> Column:
        name, kind = spec.split(" ", 1)
        v = F.get(x, k)
        if kind.startswith("array"):
            return F.filter(F.transform(F.split(v, ","), lambda y: y.try_cast("int")), lambda y: y.isNotNull()).alias(name)
        return v.try_cast(kind).alias(name)

    return rows.select(*[column(k, s) for k, s in enumerate(schema)])


def write_fields(df: DataFrame, path: str, header: str | None = None, sep: str = "\t", compression: str | None = None) -> str:
    """One line a row; arrays are joined by commas, NULL is ``.``; ``header`` goes ahead as one line."""
    one = lambda f: F.array_join(F.transform(F.col(f.name), lambda v: v.cast("string")), ",") if f.dataType.typeName() == "array" else F.col(f.name).cast("string")
    rows = df.select(F.concat_ws(sep, *[F.coalesce(one(f), F.lit(".")) for f in df.schema.fields]).alias("value"))
    if header is not None:
        rows = df.sparkSession.createDataFrame([(header,)], "value string").union(rows)
    rows.write.text(path, compression=compression)
    return path


def with_prefix(chrom: Column, how: str | None = None) -> Column:
    """'add' or 'remove' the prefix ``chr``; the prefix as a whole, not its letters."""
    bare = F.regexp_replace(chrom, "^chr", "")
    return {None: chrom, "add": F.concat(F.lit("chr"), bare), "remove": bare}[how]


def strip_letters(chrom: Column) -> Column:
    """What stripping the letters c, h and r from the left gives; kept for tables made that way."""
    return F.regexp_replace(chrom, "^[chr]+", "")


# -- readers -----------------------------------------------------------------------------
def read_chrom_sizes(spark: SparkSession, path: str) -> DataFrame:
    return fields(lines(spark, path), ("chrom string", "size bigint"))


def read_bed(spark: SparkSession, path: str, width: int = 12) -> DataFrame:
    """The first ``width`` columns of 3, 4, 6, 9 or 12."""
    if width not in (3, 4, 6, 9, 12):
        raise ValueError("a BED row has 3, 4, 6, 9 or 12 columns")
    return fields(lines(spark, path), BED[:width], r"\t" if width > 4 else r"\s+")


def bed_faults(bed: DataFrame) -> DataFrame:
    """Rows that end where they begin or before, and those that begin before the row above them in (chrom, start) of the file; needs ``row``."""
    w = W.partitionBy("chrom").orderBy("row")
    return bed.withColumn("_b", F.lag("start").over(w)).where("end <= start OR _b > start").drop("_b")


def bed_width(spark: SparkSession, path: str) -> int:
    first = lines(spark, path).first()
    return 0 if first is None else len(first[0].split("\t"))


def read_domains(spark: SparkSession, path: str) -> DataFrame:
    return read_bed(spark, path, 6)


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """(gene, starts, ends, chrom) of BED4 targets, in order of their starts."""
    return read_bed(spark, path, 4).groupBy(F.col("name").alias("gene"), "chrom").agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("t")
    ).select("gene", "chrom", F.col("t.start").alias("starts"), F.col("t.end").alias("ends"))


def in_region(df: DataFrame, chrom: object, start: int, end: int) -> DataFrame:
    return df.where((F.col("chrom") == chrom) & (F.col("start") < end) & (F.col("end") > start))


def known_names(df: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows under the name that ``sizes`` has: their own, or the one with the prefix added or taken off; others go."""
    names = small(sizes.select(F.col("chrom").alias("_n")).distinct())
    other = F.when(F.col("chrom").startswith("chr"), F.substring("chrom", 4, 1 << 20)).otherwise(F.concat(F.lit("chr"), "chrom"))
    both = df.join(names, F.col("chrom") == F.col("_n"), "left").withColumnRenamed("_n", "_own").withColumn("_other", other)
    return both.join(names, F.col("_other") == F.col("_n"), "left").withColumn("chrom", F.coalesce("_own", "_n")).where("chrom IS NOT NULL").drop("_own", "_n", "_other")


def read_loops(spark: SparkSession, path: str, prefix: str | None = None) -> DataFrame:
    x = fields(lines(spark, path), LOOP)
    return x.withColumns({c: with_prefix(F.col(c), prefix) for c in ("chrom1", "chrom2")})


def read_peaks(spark: SparkSession, path: str, prefix: str | None = None) -> DataFrame:
    """(chrom, start, end, signal, p, q) of narrow or broad peaks."""
    return fields(lines(spark, path), PEAK).select(with_prefix(F.col("chrom"), prefix).alias("chrom"), "start", "end", "signal", "p", "q")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, seq): a record for each ``>``, its lines joined; the name ends at the first white space."""
    x = spark.read.option("lineSep", ">").text(path).where("trim(value) <> ''")
    return x.select(F.regexp_extract("value", r"^(\S*)", 1).alias("chrom"), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "").alias("seq"))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Reference points of (chrom, position, gene) or (chrom, start, end, gene) lines."""
    x = F.split("value", r"\s+")
    long = F.size(x) > 3
    return lines(spark, path).select(
        x[0].alias("chrom"), x[1].try_cast("bigint").alias("start"), F.when(long, F.get(x, 2)).otherwise(x[1]).try_cast("bigint").alias("end"), F.when(long, F.get(x, 3)).otherwise(F.get(x, 2)).alias("gene")
    )


def read_background(spark: SparkSession, path: str, reach: int, step: int) -> DataFrame:
    """(rel_pos, size, prob, most, mean) at every ``step`` within ``reach``; beyond the file's ends its last rows hold."""
    x = fields(lines(spark, path), ("rel_pos bigint", "size double", "prob double", "most double", "mean double")).where("rel_pos IS NOT NULL")
    ends = x.agg(F.min("rel_pos").alias("lo"), F.max("rel_pos").alias("hi"))
    at = spark.range(-reach, reach + step, step).withColumnRenamed("id", "at").crossJoin(F.broadcast(ends))  # one row
    return at.withColumn("rel_pos", F.greatest("lo", F.least("hi", "at"))).join(F.broadcast(x), "rel_pos").select(F.col("at").alias("rel_pos"), "size", "prob", "most", "mean")  # a row per position


def read_bedgraph(spark: SparkSession, path: str) -> DataFrame:
    return fields(lines(spark, path), BEDGRAPH)


def track_over_bins(track: DataFrame, bins: DataFrame, bucket: int = 100_000) -> DataFrame:
    """(bin_id, value): the mean of a bedgraph over each bin, weighted by overlap; bins without any have none."""
    from ..operators.intervals import range_join

    x = range_join(bins.select("chrom", "start", "end", "bin_id"), track, bucket)
    both = F.least("l.end", "r.end") - F.greatest("l.start", "r.start")
    return x.groupBy(F.col("l.bin_id").alias("bin_id")).agg((F.sum(F.col("r.value") * both) / F.sum(both)).alias("value"))


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    return fields(lines(spark, path), ("rel_pos bigint", "value double"))


def read_bedgraph_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(chrom, start, end, scores) and the parameters of the header, one row (step, minDepth, maxDepth, binsize)."""
    raw = spark.read.text(path)
    head = raw.where("value LIKE '#{%'").select(F.from_json(F.substring("value", 2, 1 << 20), "step bigint, minDepth bigint, maxDepth bigint, binsize bigint").alias("h")).select("h.*")
    x = F.split("value", "\t")
    rows = lines(spark, path).select(x[0].alias("chrom"), x[1].try_cast("bigint").alias("start"), x[2].try_cast("bigint").alias("end"), F.transform(F.slice(x, 4, 1 << 20), lambda v: v.try_cast("double")).alias("scores"))
    return rows, head


def read_qc_logs(spark: SparkSession, path: str) -> DataFrame:
    """(file, key, value) of quality logs: the tab-separated lines from ``File`` on."""
    x = F.split("value", "\t")
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("at"), F.posexplode(F.split("value", "\n")).alias("n", "value"))
    rows = rows.where("trim(value) <> '' AND value NOT LIKE '#%'").select("at", "n", F.trim(x[0]).alias("key"), F.trim(F.get(x, 1)).alias("value")).where("value IS NOT NULL")
    first = rows.where("key = 'File'").groupBy("at").agg(F.min("n").alias("n0"), F.min_by("value", "n").alias("file"))
    return rows.join(first, "at").where("n > n0").select("file", "key", F.col("value").try_cast("bigint").alias("value"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment lines; header lines start with ``@``. Positions become 0-based."""
    return fields(spark.read.text(path).where("value NOT LIKE '@%'"), SAM).withColumn("pos", F.col("pos") - 1)


def paired(first: DataFrame, second: DataFrame) -> DataFrame:
    """Mates of two alignment files side by side, joined on the read name; secondary alignments go and split reads keep one record."""
    from ..operators.pairs import pick_supplementary, primary

    def side(x: DataFrame, k: int) -> DataFrame:
        x = pick_supplementary(primary(x).select("read_id", "flag", "chrom", "pos", "mapq", "cigar", "seq"))
        f = F.col("flag")
        return x.select("read_id", F.col("chrom").alias(f"chrom{k}"), F.col("pos").alias(f"pos{k}"), F.col("mapq").alias(f"mapq{k}"), (f.bitwiseAND(16) != 0).alias(f"rev{k}"), f.alias(f"flag{k}"), F.length("seq").alias(f"len{k}"), F.col("seq").alias(f"seq{k}"))

    return side(first, 1).join(side(second, 2), "read_id")


def parse_region(text: str) -> tuple[str, int, int | None, int | None]:
    """``chrom:start-end`` or ``chrom:start:end``, an optional tile size behind a further colon; other signs are dropped."""
    for c in ",;|!{}()":
        text = text.replace(c, "")
    parts = text.replace("-", ":").split(":")
    number = lambda k: int(parts[k]) if len(parts) > k and parts[k] else None
    start, end = number(1) or 0, number(2)
    if end is not None and end <= start:
        raise ValueError("a region ends behind its start")
    return parts[0], start, end, number(3)


# -- matrices ----------------------------------------------------------------------------
def write_hicpro(pixels: DataFrame, bins: DataFrame, path: str) -> tuple[str, str]:
    """A triple file and a bin file with numbers from 1."""
    n = numbered(bins)
    b = small(n.select("bin_id", "n"))
    x = pixels.join(b.toDF("bin1", "i"), "bin1").join(b.toDF("bin2", "j"), "bin2").select("i", "j", "value")
    return write_fields(x, f"{path}/matrix"), write_fields(n.select("chrom", "start", "end", "n"), f"{path}/bins")


def numbered(bins: DataFrame) -> DataFrame:
    """Bins with ``n`` from 1 over the genome: places within chromosomes after the sizes of those before."""
    per = bins.groupBy("chrom").agg(F.count(F.lit(1)).alias("c"))
    before = per.select("chrom", (F.sum("c").over(W.orderBy("chrom").rowsBetween(W.unboundedPreceding, 0)) - F.col("c")).alias("o"))  # a row per chromosome
    return bins.join(F.broadcast(before), "chrom").withColumn("n", F.col("o") + F.row_number().over(W.partitionBy("chrom").orderBy("start"))).drop("o")


def read_hicpro(spark: SparkSession, matrix: str, bins: str) -> DataFrame:
    """(chrom1, start1, chrom2, start2, value)."""
    b = small(fields(lines(spark, bins), ("chrom string", "start bigint", "end bigint", "n bigint")))
    x = fields(lines(spark, matrix), ("i bigint", "j bigint", "value double"))
    side = lambda k, n: b.select(F.col("n").alias(n), F.col("chrom").alias(f"chrom{k}"), F.col("start").alias(f"start{k}"))
    return x.join(side(1, "i"), "i").join(side(2, "j"), "j").select("chrom1", "start1", "chrom2", "start2", "value")


def write_ginteractions(pixels: DataFrame, bins: DataFrame, path: str) -> str:
    """chrom, start, end of both bins and the value."""
    b = small(bins.select("bin_id", "chrom", "start", "end"))
    x = pixels.join(b.toDF("bin1", "c1", "s1", "e1"), "bin1").join(b.toDF("bin2", "c2", "s2", "e2"), "bin2")
    return write_fields(x.select("c1", "s1", "e1", "c2", "s2", "e2", "value"), path)


def read_2d_text(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(bin1, bin2, value) of seven-column lines with numeric chromosomes; of several lines in a cell the last place wins."""
    x = fields(lines(spark, path), ("c1 bigint", "s1 bigint", "e1 bigint", "c2 bigint", "s2 bigint", "e2 bigint", "value double"))
    at = lambda k: (F.col(f"c{k}") * STRIDE + F.floor(F.col(f"s{k}") / size)).cast("bigint")
    cells = x.select(F.least(at(1), at(2)).alias("bin1"), F.greatest(at(1), at(2)).alias("bin2"), "s1", "s2", "value")
    return cells.groupBy("bin1", "bin2").agg(F.max_by("value", F.struct("s1", "s2")).alias("value"))


def write_homer(pixels: DataFrame, bins: DataFrame, path: str) -> str:
    """A dense square, compressed: a line per bin with the values of all bins, names ``chrom-start`` ahead of rows and columns.

    The square of the bins is the format's own size. A line is its stored cells in order with a run
    of zeros ahead of each, so its cost is that of its text and its stored cells.
    """
    from ..frames import mirror

    n = numbered(bins).select("bin_id", "n", F.concat_ws("-", F.col("chrom").cast("string"), F.col("start").cast("string")).alias("name"))
    total = F.lit(n.count())
    stored = F.array_sort(F.collect_list(F.struct("j", "value")))
    cells = mirror(pixels).join(small(n.select(F.col("bin_id").alias("bin2"), F.col("n").alias("j"))), "bin2").groupBy(F.col("bin1").alias("bin_id")).agg(stored.alias("m"))
    zeros = lambda k: F.repeat(F.lit("\t0.0"), k.cast("int"))
    cells = cells.select("bin_id", "m", F.col("m.j").alias("j")).withColumn("before", F.concat(F.array(F.lit(0).cast("bigint")), F.slice("j", 1, F.size("j") - 1)))
    one = F.zip_with("m", "before", lambda c, b: F.concat(zeros(c["j"] - b - 1), F.lit("\t"), c["value"].cast("string")))
    row = F.when(F.col("m").isNull(), zeros(total)).otherwise(F.concat(F.array_join(one, ""), zeros(total - F.element_at("j", -1))))
    head = n.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "name"))), lambda s: s["name"]), "\t").alias("names")).select(F.concat(F.lit("HiCMatrix (directory=.)\tRegions\t"), "names").alias("value"))
    n.join(cells, "bin_id", "left").select(F.concat("name", F.lit("\t"), "name", row).alias("value")).union(head).write.text(path, compression="gzip")
    return path


def read_homer(spark: SparkSession, path: str) -> DataFrame:
    """(chrom1, start1, chrom2, start2, value) of the upper triangle, zeros left out; cells written ``0.0`` are passed over as bytes."""
    x = F.split("value", "\t")
    raw = spark.read.text(path)
    names = raw.where("value LIKE 'HiCMatrix%'").select(F.posexplode(F.slice(x, 3, 1 << 20)).alias("k", "other"))

    def run(batches):
        for b in batches:
            for line in b.column("value"):
                text = np.frombuffer(line.as_buffer(), np.uint8)
                tabs = np.append(np.flatnonzero(text == 9), len(text))
                start, end = tabs[1:-1] + 1, tabs[2:]
                zero = end - start == 3
                at = start[zero]
                zero[zero] = (text[at] == 48) & (text[at + 1] == 46) & (text[at + 2] == 48)
                k = np.flatnonzero(~zero)
                name = text[: tabs[0]].tobytes().decode()
                values = [text[i:j].tobytes().decode() for i, j in zip(start[k], end[k], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(k), pa.string()), pa.array(k, pa.int32()), pa.array(values, pa.string())], ["name", "k", "v"])

    cells = raw.where("value NOT LIKE 'HiCMatrix%'").mapInArrow(run, "name string, k int, v string").select("name", "k", F.col("v").cast("double").alias("value")).where("value <> 0")
    cells = cells.join(F.broadcast(names), "k")  # a row per bin
    part = lambda c, k, kind: F.get(F.split(c, "-"), k).cast(kind)
    out = cells.select(part("name", 0, "string").alias("chrom1"), part("name", 1, "bigint").alias("start1"), part("other", 0, "string").alias("chrom2"), part("other", 1, "bigint").alias("start2"), "value")
    return out.where("chrom1 < chrom2 OR chrom1 = chrom2 AND start1 <= start2")


# -- writers of results ------------------------------------------------------------------
def write_domains(domains: DataFrame, path: str, delta: float = 0.01) -> str:
    """BED9 of (chrom, start, end, score, k): names ``ID_<delta>_<k>``, two colours by turns."""
    rgb = F.when(F.col("k") % 2 == 0, "51,160,44").otherwise("31,120,180")
    score = F.format_string("%.12f", F.col("score"))
    x = domains.select("chrom", "start", "end", F.concat(F.lit(f"ID_{delta}_"), F.col("k").cast("string")).alias("name"), score.alias("score"), F.lit(".").alias("strand"), F.col("start").alias("s"), F.col("end").alias("e"), rgb.alias("rgb"))
    return write_fields(x, path)


def write_boundaries(b: DataFrame, path: str) -> tuple[str, str]:
    """BED6 and GFF of boundaries (chrom, start, end, id, score, delta, p)."""
    name, f = F.format_string("B%05d", F.col("id")), lambda c: F.format_string("%.12f", F.col(c))
    bed = write_fields(b.select("chrom", "start", "end", name.alias("name"), f("score").alias("score"), F.lit(".").alias("strand")), f"{path}/bed")
    info = F.concat(F.lit("ID="), name, F.lit(";delta="), f("delta"), F.lit(";pvalue="), f("p"), F.lit(";tad_sep="), f("score"))
    gff = b.select("chrom", F.lit("contactloom").alias("source"), F.lit("boundary").alias("kind"), "start", "end", f("score").alias("score"), F.lit(".").alias("s"), F.lit(".").alias("f"), info.alias("info"))
    return bed, write_fields(gff, f"{path}/gff")


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, end, and the attributes as a map)."""
    x = fields(lines(spark, path), ("chrom string", "source string", "kind string", "start bigint", "end bigint", "score double", "strand string", "frame string", "info string"))
    return x.select("chrom", "start", "end", "score", F.str_to_map("info", F.lit(";"), F.lit("=")).alias("info"))


def write_bedgraph_matrix(scores: DataFrame, path: str, step: int, least: int, most: int, binsize: int) -> str:
    """(chrom, start, end, scores) with the parameters as JSON in the first line."""
    head = '#{"step": %d, "minDepth": %d, "maxDepth": %d, "binsize": %d}' % (step, least, most, binsize)
    x = scores.select("chrom", "start", "end", F.array_join(F.transform("scores", lambda v: v.cast("string")), "\t").alias("scores"))
    return write_fields(x, path, head)


def write_qc_log(row: DataFrame, path: str, name: str) -> str:
    """One log of a one-row counter table: a line per counter under the file's name."""
    kinds = [f.name for f in row.schema.fields if f.dataType.typeName() in ("long", "integer")]
    text = F.concat_ws("\n", F.lit(f"File\t{name}"), *[F.concat_ws("\t", F.lit(k), F.col(k).cast("string")) for k in kinds])
    row.select(text.alias("value")).coalesce(1).write.text(path)
    return path


def write_parts(df: DataFrame, path: str, *by: str) -> str:
    """A table with a folder per value of ``by``: resolutions, samples, genes."""
    df.write.partitionBy(*by).parquet(path)
    return path


def axis_label(position: float) -> str:
    """A position in the largest unit that keeps it at 1 or more."""
    for unit, size in (("Mb", 1e6), ("Kb", 1e3)):
        if abs(position) >= size:
            return f"{position / size:.2f} {unit}"
    return f"{position:.0f} b"
