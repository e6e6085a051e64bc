"""Quality rules: a threshold table compiled into one projection, evaluated without user functions.

Every measure is an expression over the row, so the scan is the only stage: no
shuffle, no state between rows, and nothing that a lost executor could take along.

Defined cases: NULL and empty texts have zero in every count and fail the base
rule; repeated rows are judged one by one; further columns of the input do not
reach the measures, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let, words

STOP_WORDS = (
    "the of and to in that is it for with be was on are this "
    "le la les de des et un une que dans du en pour est au "
    "der die das und den von zu mit nicht ein ist sich im dem "
    "el los que y por con para las una del se"
)

STOP_FORMS = tuple(dict.fromkeys(f for w in STOP_WORDS.split() for f in (w, w.capitalize(), w.upper())))

#: name, measure, comparison that rejects, factor, reference measure, percent:
#: a document is rejected if 100 * measure <op> percent * reference.
RULES: tuple[tuple[str, str, str, int, str], ...] = (
    ("short_words", "word_chars", "<", 200, "n_words"),
    ("long_words", "word_chars", ">", 1500, "n_words"),
    ("symbols", "n_symbols", ">", 10, "n_words"),
    ("repeated_lines", "n_dup_lines", ">", 50, "n_lines"),
    ("bullet_lines", "n_bullet_lines", ">", 90, "n_lines"),
    ("ellipsis_lines", "n_ellipsis_lines", ">", 30, "n_lines"),
    ("shouting", "n_capital_runs", ">", 60, "n_words"),
    ("digits", "n_digits", ">", 40, "word_chars"),
    ("few_stop_words", "n_stop_words", "<", 1, "n_words"),
)
BASE_MIN_WORDS, BASE_REPEAT_PERCENT = 50, 50


def _bits(n: Column) -> Column:
    """Bits that hold any place below ``n``."""
    return F.length(F.bin(n.cast("bigint")))


def _shift(name: str, value: Column, by: Column) -> Column:
    return F.call_function(name, value, by.cast("int"))


def _with_places(df: DataFrame) -> DataFrame:
    """Adds ``_p``: the places of the 3-word windows of ``_w`` that occur twice or more.

    A window becomes one long, hash bits above and its place below, so that a
    primitive sort brings equal windows together; neighbours up to three places
    off with equal hash bits are compared word by word before they count, so up to
    two other windows with the same 40 or more bits may lie between two equal ones.
    """
    w, s = F.col("_w"), F.col("_s")
    keys = F.transform(
        w,
        lambda x, i: _shift("shiftleft", F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)), F.col("_b")).bitwiseOR(i.cast("bigint")),
    )
    df = df.withColumn("_b", _bits(F.size(w))).withColumn("_s", F.sort_array(keys))

    def place(x: Column) -> Column:
        return x.bitwiseAND(_shift("shiftleft", F.lit(1).cast("bigint"), F.col("_b")) - 1).cast("int")

    def equal(x: Column, y: Column) -> Column:
        same = _shift("shiftright", x.bitwiseXOR(y), F.col("_b")) == 0
        for k in range(3):
            same = same & (F.get(w, place(x) + k) == F.get(w, place(y) + k))
        return same

    def repeated(x: Column, k: Column) -> Column:
        found = F.lit(False)
        for step in (1, -1, 2, -2, 3, -3):
            found = found | F.coalesce(equal(x, F.get(s, k + step)), F.lit(False))
        return found

    twice = F.filter(s, repeated)
    return df.withColumn("_p", F.sort_array(F.transform(twice, place)))


def _covered(p: Column) -> Column:
    """Words that the windows at the sorted places ``p`` cover: three each, less what the next one covers too."""
    return F.aggregate(
        F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))),
        F.lit(0).cast("bigint"),
        lambda a, x: a + x,
    )


def _line_measures(text: Column) -> Column:
    """n_lines (lines with a word), n_dup_lines, n_bullet_lines and n_ellipsis_lines."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    return let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("bigint").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
            F.size(F.filter(x, lambda y: F.substring(F.ltrim(y), 1, 1).isin("-", "*", "•"))).cast("bigint").alias("n_bullet_lines"),
            F.size(F.filter(x, lambda y: y.endswith("...") | y.endswith("…"))).cast("bigint").alias("n_ellipsis_lines"),
        ),
    )


def measures(docs: DataFrame, text: str = "text", keep: list[str] | None = None, only_kept: bool = False) -> DataFrame:
    """Two structs: ``_row``, the row of ``docs`` (its columns ``keep``), and ``_quality``, all measures and the two verdicts.

    The input stays packed beside the work columns, so names cannot clash.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)])
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(row.alias("_row"), t.alias("_t"))
    df = _with_places(df.withColumn("_w", words(F.col("_t"))))
    t, w = F.col("_t"), F.col("_w")
    m = F.struct(
        F.size(w).cast("bigint").alias("n_words"),
        _covered(F.col("_p")).alias("n_repeat_words"),
        F.size(F.filter(w, lambda x: x.isin(*STOP_FORMS))).cast("bigint").alias("n_stop_words"),
        _line_measures(t).alias("l"),
        (F.length(t) - F.regexp_count(t, F.lit(r"[\x20\x09-\x0D]"))).cast("bigint").alias("word_chars"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.regexp_count(t, F.lit(r"\p{Lu}{3,}")).cast("bigint").alias("n_capital_runs"),
        F.regexp_count(t, F.lit(r"[0-9]")).cast("bigint").alias("n_digits"),
    )

    def verdicts(q: Column) -> Column:
        of = {
            **{k: q[k] for k in ("n_words", "n_repeat_words", "n_stop_words", "word_chars", "n_symbols", "n_capital_runs", "n_digits")},
            **{k: q["l"][k] for k in ("n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines")},
        }
        base = (of["n_words"] < BASE_MIN_WORDS) | (100 * of["n_repeat_words"] > BASE_REPEAT_PERCENT * of["n_words"])
        broken = [
            F.when(100 * of[m] < pct * of[ref] if op == "<" else 100 * of[m] > pct * of[ref], F.lit(name))
            for name, m, op, pct, ref in RULES
        ]
        failed = F.concat_ws(",", *broken)
        return F.struct(
            *[c.alias(k) for k, c in of.items()],
            base.alias("base_failed"),
            failed.alias("failed_rules"),
            (~base & (failed == "")).alias("kept"),
        )

    # filters on the verdicts would be pushed below the projections and repeat them; a generator stays above
    judged = F.transform(F.array(m), verdicts)
    return df.select("_row", F.explode(F.filter(judged, lambda v: v["kept"]) if only_kept else judged).alias("_quality"))


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its measures, base verdict, broken rules and verdict."""
    return measures(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), keep=["doc_id"]).select("_row.doc_id", "_quality.*")


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that pass, with their own columns."""
    return measures(docs, text, only_kept=True).select("_row.*")
