"""Line dedup over the suffix intervals of line-id sequences, by the names of their shortest counting runs.

Lines are cut into units behind punctuation, so that a passage joined to other
text within its first and last line still shares the units between. A "line" below
is such a unit; its id is a 64-bit hash of the unit without spaces around it. A run
that begins or ends within a unit loses that unit.
A run counts if its lines have ``min_words`` words or more, so for each position
the shortest such run that starts there decides, and the shortest that ends
there. Positions whose runs have equal names are the intervals of the suffix array with
that run in common. Their order among each other decides nothing here, so names are 128
hash bits over the run's line ids, which need no round of their own over all positions,
where ranks would. (A false copy would need a run of equal lines around two different
ones with equal ids, or 128 equal bits.) All copies in an interval but the first in
(doc_id, text, line) order are deleted. The union of these shortest runs is the union of
all maximal repeated runs: a line of a maximal run lies in the shortest one from it, or
in the shortest one that ends with the run.

Most positions repeat nothing, so few of them are named. Texts first meet by keys that any
two texts with a common run share (``_anchors``), only those that share one go on, and
their sequences are cut where a key is not shared (``_stretches``). No repeated run is
lost by either. Long blocks of one-word lines within them need no search for the ends of
runs (``_pieces``). Only documents that lose something, and few others that a table
of bits of bounded size cannot tell from them, are shuffled with their text.

Documents with the text of an earlier one are later copies as a whole; their lines
take no part in the rest. Sequences are arrays of one document; everything else
runs on joins, aggregates, which are combined before they are shuffled, and windows within one document.

Defined cases: NULL texts have no lines and stay, an empty text has one without a word;
lines without a word are no part of runs and stay; rows that repeat a doc_id and text
are one document; documents without a doc_id come first in order and stay; an empty
table gives no rows; further columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, let, stored

MIN_WORDS = 50
#: A unit of a line ends behind punctuation where white space and more text, or behind CJK marks more text, follows. So no unit is without a word, but for lines without one.
_END = r"[.,;:!?…。！？；，、](?:(?=[ \t]+\S)|(?<=[。！？；，、])(?=\S))"
#: A unit's number is that of its physical line times this, and its place in the line.
STEP = 1 << 31
_WHOLE = (1 << 31) - 1
#: Bits of a place in the tables of bits that tell which documents need no shuffle: 4 MB, whatever the input.
BITS = 25


def _cut(text: Column) -> Column:
    """The units of a text or line: line breaks set at their ends, then a plain split at line breaks."""
    return F.split(F.regexp_replace(text, _END, "$0\n"), "\n", -1)


def _units(text: Column) -> Column:
    """For each physical line the array of its units; they joined give the line."""
    return F.transform(F.split(text, "\n", -1), _cut)


def _text_key(text: Column) -> Column:
    return F.xxhash64(text)


def _cut_plain(text: Column) -> Column:
    """As ``_cut`` but for units without a word and spaces around units, where a text has neither tabs nor marks beyond ASCII: the pattern looks back at spaces alone."""
    return F.split(text, r"[ \n](?<=\n|[.,;:!?] )", -1)


def _any(text: Column, marks: str | list[str]) -> Column:
    found = F.lit(False)
    for c in marks:
        found = found | F.contains(text, F.lit(c))
    return found


def _has_word(x: Column) -> Column:
    """Whether a unit has a word; its first character behind spaces tells it for nearly all."""
    trimmed = F.trim(x)
    return F.when(F.ascii(trimmed) > 32, True).when(trimmed == "", False).otherwise(x.rlike(WORD))


def _sequences(docs: DataFrame) -> DataFrame:
    """d, t (text key), u: the units with a word, in order, as structs of a (the id) and w (words)."""
    text = F.col("text")
    special = _any(text, "\t") | (F.octet_length(text) != F.length(text)) & _any(text, "…。！？；，、")
    # where all white space within lines is single spaces, spaces count the words
    odd = _any(text, ["  ", "\t", "\r", "\x0b", "\x0c"])
    units = F.when(special, _cut(text)).otherwise(_cut_plain(text))
    trimmed = F.filter(F.transform(units, lambda x: F.trim(x)), lambda x: (F.ascii(x) > 32) | (x != "") & x.rlike(WORD))
    spaces = lambda x: F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    item = lambda x, o: F.struct(F.xxhash64(x).alias("a"), F.when(o, F.regexp_count(x, F.lit(WORD))).otherwise(spaces(x)).alias("w"))
    rows = docs.where("text IS NOT NULL")
    return rows.select(F.col("doc_id").alias("d"), _text_key(text).alias("t"), let(odd, lambda o: F.transform(trimmed, lambda x: item(x, o))).alias("u"))


def whole_copies(rows: DataFrame) -> DataFrame:
    """(d, t) of the documents, of ``rows`` (d, t), whose text an earlier one has."""
    least = rows.groupBy("t").agg(F.min("d").alias("f"), F.max("d").alias("z"), F.count_if(F.col("d").isNull()).alias("free"))
    # tables on both sides of the join, so that a frequent text's rows need not be one task's
    least = stored(least.where("z > f OR z IS NOT NULL AND free > 0").select("t", F.when(F.col("free") == 0, F.col("f")).alias("f")))
    return stored(rows.join(least, "t").where("d IS NOT NULL AND (f IS NULL OR d > f)").select("d", "t")).distinct()


def _runs(parts: DataFrame, min_words: int) -> DataFrame:
    """d, t, j, n (lines), a and b (names): for each position the shortest run of ``min_words`` words from it, and the shortest that ends
    before it if no shortest one from a position is the same; in pieces u of texts from their line o on.

    Positions are in order of the words before them, so a run is a frame of ``min_words`` words; for the runs that end before a position, each has the line before it too.
    In an ``even`` piece every ``min_words`` lines are a run; it goes along as one row.
    """
    text = Window.partitionBy("k", "free", "t", "o", "even")
    end = F.array(F.struct(F.lit(None).cast("bigint").alias("a"), F.lit(0).alias("w")))
    given = ["k", "free", "t", "o", "even", "words", "e"]
    lines = parts.withColumn("e", F.when(F.col("even"), F.col("u.a")))
    lines = lines.select(*given, F.posexplode(F.when(F.col("even"), end).otherwise(F.concat("u", end))).alias("j", "u")).select(*given, (F.col("o") + F.col("j")).alias("j"), "u.a", "u.w")
    behind = text.orderBy("j")
    s = F.coalesce(F.sum("w").over(behind.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    lines = lines.select("*", s.alias("s"), F.lag("a").over(behind).alias("pa"), F.lag("w").over(behind).alias("pw"))
    words = text.orderBy("s")
    ahead, back = words.rangeBetween(0, min_words - 1), words.rangeBetween(1 - min_words, 0)
    lines = lines.select(F.when(~F.col("free"), F.col("k")).alias("d"), "t", "j", "s", "pw", "even", "words", "e", F.collect_list("a").over(ahead).alias("x"), F.sum("pw").over(back).alias("v"), F.collect_list("pa").over(back).alias("y"))

    def run(x: Column, j: Column) -> Column:
        return F.struct(j.alias("j"), F.size(x).alias("n"), F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))

    forth = F.when(F.col("s") + min_words <= F.col("words"), run(F.col("x"), F.col("j")))
    other = F.when(F.col("v") - F.col("pw") >= min_words, run(F.col("y"), F.col("j") - F.size("y")))
    evens = F.transform(F.sequence(F.lit(0), F.size("e") - min_words), lambda i: F.get(F.transform(F.array(F.slice("e", i + 1, min_words)), lambda x: run(x, F.col("j") + i)), 0))
    return lines.select("d", "t", F.explode(F.when(F.col("even"), evens).otherwise(F.array_compact(F.array(forth, other)))).alias("r")).select("d", "t", "r.*")


def _anchors(seqs: DataFrame, min_words: int) -> DataFrame:
    """d, t, ``own`` (whether lines repeat within the text as those of a run would) and ``keys``: texts that share a run share a key.

    A run is one line of ``min_words``; or has a long line, of a quarter of them or more, with a neighbour on one side; or
    five short lines or more, so two neighbouring fours of short lines. The keys are such lines, all pairs with a long line and the lesser names of such two fours.
    """
    long = -(-min_words // 4)
    then = lambda x, y, by: x.bitwiseXOR(F.shiftrightunsigned(y, by))
    near = lambda name, i: F.get(F.col(name), i)
    few, whole = lambda u: u["w"] < long, lambda u: u["w"] >= min_words
    df = seqs
    df = df.withColumn("x", F.array_compact(F.transform("u", lambda u, i: F.when(few(u), None).when(whole(u), u["a"]).otherwise(then(u["a"], near("u", i + 1)["a"], 1)))))
    df = df.withColumn("y", F.array_compact(F.transform("u", lambda u, i: F.when(few(u) | whole(u), None).otherwise(then(near("u", i - 1)["a"], u["a"], 1)))))
    # NULL where a line of the two, or the four, is long or missing
    df = df.withColumn("s", F.transform("u", lambda u: F.when(few(u), u["a"]))).drop("u")
    df = df.withColumn("p", F.transform("s", lambda x, i: then(x, near("s", i + 1), 1)))
    df = df.withColumn("q", F.transform("p", lambda x, i: then(x, near("p", i + 2), 2))).drop("s", "p")
    least = F.array_compact(F.transform("q", lambda x, i: F.when(x < near("q", i + 1), x).when(x.isNotNull(), near("q", i + 1))))
    df = df.withColumn("z", least).withColumn("q", F.array_compact("q"))
    own = F.lit(False)
    for c in "xyq":
        own = own | (F.size(F.array_distinct(c)) < F.size(c))
    return df.select("d", "t", own.alias("own"), F.array_distinct(F.concat("x", "y", "z")).alias("keys"))


def _sharing(anchors: DataFrame) -> DataFrame:
    """t, ``own`` and ``ks`` (the keys that other texts have) of the texts that may have a repeated run."""
    keys = anchors.select("t", F.explode("keys").alias("key"))
    often = keys.groupBy("key").agg(F.min("t").alias("p"), F.max("t").alias("q")).where("p <> q").select("key")
    found = keys.join(stored(often), "key").select("t", "key", F.lit(False).alias("own"))
    found = found.unionByName(anchors.where("own").select("t", F.lit(None).cast("bigint").alias("key"), "own"))
    return found.groupBy("t").agg(F.max("own").alias("own"), F.collect_set("key").alias("ks"))


def _stretches(seqs: DataFrame, min_words: int) -> DataFrame:
    """The sequences cut between neighbours whose key no other text has, as no repeated run has both: o (number of the first line), u and ``words``; only those with words enough.

    Texts that repeat lines of their own stay whole.
    """
    long = -(-min_words // 4)
    mid = lambda u: (u["w"] >= long) & (u["w"] < min_words)
    then = lambda i: F.get(F.col("u"), i + 1)
    alone = lambda u, i: (mid(u) | mid(then(i))) & ~F.array_contains("ks", u["a"].bitwiseXOR(F.shiftrightunsigned(then(i)["a"], 1)))
    size = F.size("u")
    cut = F.transform("u", lambda u, i: F.when(i + 1 < size, F.when(alone(u, i), i + 1)))
    df = seqs.withColumn("c", F.when(F.col("own"), F.array(F.lit(0), size)).otherwise(F.concat(F.array(F.lit(0)), F.array_compact(cut), F.array(size))))
    part = lambda c, k: F.struct(c.alias("o"), F.slice("u", c + 1, F.greatest(F.get(F.col("c"), k + 1) - c, F.lit(0))).alias("u"))
    df = df.select("k", "free", "t", "own", F.explode(F.transform(F.slice("c", 1, F.size("c") - 1), part)).alias("p")).select("k", "free", "t", "own", "p.*")
    return df.withColumn("words", F.aggregate("u", F.lit(0), lambda n, u: n + u["w"])).where(F.col("words") >= min_words)


def _pieces(parts: DataFrame, min_words: int) -> DataFrame:
    """The stretches of texts that repeat lines of their own, cut into ``even`` pieces, their long blocks of one-word lines, and what is between with ``min_words`` - 1 lines of the blocks on either side.

    A shortest run lies in one piece: not in a block only if a line outside is in it, and then with less than ``min_words`` of the block's.
    """
    u, size, over = F.col("u"), F.size("u"), min_words - 1
    one = lambda i: F.coalesce(F.get(u, i)["w"] == 1, F.lit(False))
    at = lambda step, by: F.array_compact(F.transform(u, lambda x, i: F.when((x["w"] == 1) & ~one(i + step), i + by)))
    blocks = F.filter(F.arrays_zip(at(-1, 0).alias("lo"), at(1, 1).alias("hi")), lambda b: b["hi"] - b["lo"] >= 2 * min_words)
    df = parts.withColumn("q", F.when(F.col("own"), blocks).otherwise(F.array().cast("array<struct<lo:int,hi:int>>")))
    piece = lambda lo, hi, even: F.struct((F.col("o") + lo).alias("o"), F.slice("u", lo + 1, hi - lo).alias("u"), F.lit(even).alias("even"))
    start = F.concat(F.array(F.lit(0)), F.transform("q", lambda b: b["hi"] - over))
    end = F.concat(F.transform("q", lambda b: b["lo"] + over), F.array(size))
    between = F.transform(F.arrays_zip(start.alias("lo"), end.alias("hi")), lambda b: piece(b["lo"], b["hi"], False))
    df = df.select("k", "free", "t", F.explode(F.concat(between, F.transform("q", lambda b: piece(b["lo"], b["hi"], True)))).alias("p")).select("k", "free", "t", "p.*")
    return df.withColumn("words", F.aggregate("u", F.lit(0), lambda n, u: n + u["w"])).where(F.col("words") >= min_words)


def _bits(keys: DataFrame, key: Column) -> DataFrame:
    """(bucket, bits): one bit of ``1 << BITS`` for each key, a table of bounded size."""
    place = F.pmod(key, F.lit(1 << BITS))
    return keys.select(F.shiftright(place, 15).alias("bucket"), (place % (1 << 15)).alias("n")).groupBy("bucket").agg(F.expr("bitmap_construct_agg(n)").alias("bits"))


def _may_have(rows: DataFrame, key: Column, bits: DataFrame) -> DataFrame:
    """``rows`` with ``_may``: false only for keys that are not among those of ``bits``."""
    place = F.pmod(key, F.lit(1 << BITS))
    n = place % (1 << 15)
    byte = F.conv(F.hex(F.substring("bits", F.floor(n / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(F.floor(byte / F.pow(F.lit(2), n % 8)) % 2 == 1, F.lit(False))
    found = rows.withColumn("_bucket", F.shiftright(place, 15)).join(F.broadcast(bits), F.col("_bucket") == F.col("bucket"), "left")
    return found.withColumn("_may", may).drop("_bucket", "bucket", "bits")


def later_copies(docs: DataFrame, anchors: DataFrame, later: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(d, t, parts): stretches of lines (their numbers j, both included) that lie in a later copy of a repeated run."""
    sharing = stored(_sharing(anchors))
    text = docs.where("text IS NOT NULL").withColumn("t", _text_key(F.col("text")))
    name = lambda df: df.withColumn("k", F.coalesce("d", F.lit(0).cast("bigint"))).withColumn("free", F.col("d").isNull()).drop("d")
    # one document of each text that shares, and its sequence; the rest is not shuffled
    chosen = name(anchors.select("d", "t").distinct().join(later, ["d", "t"], "left_anti").join(sharing, "t"))
    some = _may_have(text, F.col("t"), stored(_bits(sharing, F.col("t")))).where("_may")
    seqs = name(_sequences(some)).join(chosen, ["k", "free", "t"])
    seqs = seqs.withColumn("_n", F.row_number().over(Window.partitionBy("k", "free", "t").orderBy("t"))).where("_n = 1")
    rep = _runs(_pieces(_stretches(seqs, min_words), min_words), min_words)
    at = stored(rep.withColumnRenamed("d", "doc"))
    first = stored(at.groupBy("a", "b", "n").agg(F.min(F.struct("doc", "t", "j")).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"))
    copies = at.join(first, ["a", "b", "n"]).where(F.struct("doc", "t", "j") > F.col("first"))
    parts = copies.groupBy("doc", "t").agg(F.sort_array(F.collect_list(F.struct(F.col("j").alias("from"), (F.col("j") + F.col("n") - 1).alias("to")))).alias("p"))

    def merge(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["from"].alias("from"), F.greatest(last["to"], x["to"]).alias("to"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["to"] >= x["from"] - 1), joined).otherwise(F.concat(acc, F.array(x)))

    none = F.array().cast("array<struct<from:int,to:int>>")
    merged = F.aggregate("p", none, merge)
    return parts.select(F.col("doc").alias("d"), "t", merged.alias("parts"))


def _with_gone(docs: DataFrame, min_words: int) -> DataFrame:
    """``_row``, the row as a struct, and ``_left``: NULL, or the text that is left and the lines lost of a document that loses some."""
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    anchors = stored(_anchors(_sequences(plain), min_words))
    later = stored(whole_copies(anchors.select("d", "t")))
    whole = F.array(F.struct(F.lit(0).alias("from"), F.lit(_WHOLE).alias("to")))
    gone = stored(later_copies(plain, anchors, later, min_words).unionByName(later.withColumn("parts", whole)))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("bigint").alias("d"), _text_key(F.col("text")).alias("t"))
    text, parts = F.col("_row.text"), F.col("parts")
    # a whole copy with too few words for a run stays
    few = (F.get(parts, 0)["to"] == _WHOLE) & (F.regexp_count(text, F.lit(WORD)) < min_words)
    left = F.when(parts.isNotNull() & ~few, let(_units(text), lambda u: _left(u, parts))).alias("_left")
    # texts that lose nothing need not be shuffled
    rows = _may_have(rows, F.xxhash64("d", "t"), stored(_bits(gone, F.xxhash64("d", "t"))))
    met = rows.where("_may").join(gone, ["d", "t"], "left").select("_row", left)
    return met.unionByName(rows.where("NOT _may").select("_row", F.lit(None).cast(met.schema["_left"].dataType).alias("_left")))


def _left(units: Column, parts: Column) -> Column:
    """Struct of ``text``, the units that are left joined again, a line without any going with its line break; and ``lost``, the numbers of such lines."""
    number = lambda i, k: i.cast("bigint") * STEP + k
    every = F.flatten(F.transform(units, lambda u, i: F.transform(u, lambda x, k: number(i, k))))
    worded = F.filter(F.flatten(F.transform(units, lambda u, i: F.transform(u, lambda x, k: F.when(_has_word(x), number(i, k))))), lambda n: n.isNotNull())
    gone = let(worded, lambda w: F.flatten(F.transform(parts, lambda p: F.slice(w, p["from"] + 1, F.greatest(F.least(p["to"], F.size(w) - 1) - p["from"] + 1, F.lit(0))))))
    line = lambda n: F.floor(n / STEP)

    def joined(left: Column) -> Column:
        pieces = F.transform(
            left,
            lambda n, k: F.concat(F.when((k == 0) | (line(F.get(left, k - 1)) == line(n)), "").otherwise("\n"), F.get(F.get(units, line(n).cast("int")), (n % STEP).cast("int"))),
        )
        lost = F.array_except(F.sequence(F.lit(0), F.size(units) - 1).cast("array<bigint>"), F.transform(left, line))
        return F.struct(F.array_join(pieces, "").alias("text"), lost.alias("lost"))

    return let(F.array_except(every, gone), joined)


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_deleted, deleted (numbers from 0 of the lines deleted whole) and the text that is left, also without parts of lines."""
    df = _with_gone(docs.select("doc_id", "text"), min_words)
    text, left = F.col("_row.text"), F.col("_left")
    return df.select(
        "_row.doc_id",
        F.coalesce(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size(left["lost"]), F.lit(0)).cast("bigint").alias("n_deleted"),
        F.array_join(left["lost"], ",").alias("deleted"),
        F.when(left.isNull(), text).otherwise(left["text"]).alias("text"),
    )


def without_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with later copies of runs cut out of ``text``, ``n_chars`` following; those left without a word go."""
    df = _with_gone(docs, min_words)
    row, left = F.col("_row"), F.col("_left")
    text = F.when(left.isNull(), row["text"]).otherwise(left["text"])
    out = df.select(*[(text if c == "text" else row[c]).alias(c) for c in docs.columns], left.isNotNull().alias("_cut"))
    out = out.where(~F.col("_cut") | F.col("text").rlike(WORD))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_cut"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
