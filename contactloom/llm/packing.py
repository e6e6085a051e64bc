"""Best-fit packing of token sequences, with Martello-Toth dominance reduction.

Lengths lie between 1 and the capacity, so the whole instance is a histogram of
at most ``capacity`` numbers, whatever the corpus holds. The driver reduces and
packs that histogram, each step for all documents of a length at once, and so
gets a bounded table: the n-th piece of a length goes to which sequence and
place. Executors number the pieces of each length and look the table up.

Defined cases: NULL text is an empty one (the end id alone); repeated rows are
packed one by one; an empty table gives no pieces; further columns are ignored.
"""

from __future__ import annotations

import itertools
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut
from .tokens import ranked

END_ID, CAPACITY = 2, 1024


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents of up to ``capacity`` ids whole, longer ones cut from the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ranked(tokenizer).encode_to_numpy
        end = np.array([END_ID], "<u4")
        for batch in batches:
            doc, piece, start, length, crc = (array("q") for _ in range(5))
            null: list[bool] = []
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.concatenate([encode(text.as_py() or "", allowed_special="all").astype("<u4", copy=False), end])
                n, key = len(ids), key.as_py()
                first = n if n <= capacity else n % capacity or capacity
                bounds = [0, *range(first, n + 1, capacity)]
                for k, (a, b) in enumerate(itertools.pairwise(bounds)):
                    doc.append(0 if key is None else key)
                    null.append(key is None)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b]))
            columns = [pa.array(np.array(x, np.int64)) for x in (piece, start, length, crc)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(doc, np.int64), mask=np.array(null, bool)), columns[0].cast(pa.int32()), *columns[1:]], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    return rows.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def _largest(n: np.ndarray, most: int) -> int:
    """The largest length up to ``most`` of which some are left, or 0."""
    found = np.flatnonzero(n[: most + 1])
    return int(found[-1]) if len(found) else 0


def _best_pair(n: np.ndarray, room: int) -> int:
    """The largest sum up to ``room`` of two pieces that are left, or 0."""
    sizes = np.flatnonzero(n[: room + 1])
    best, lo, hi = 0, 0, len(sizes) - 1
    while lo <= hi:
        total = int(sizes[lo] + sizes[hi])
        if total <= room and (lo < hi or n[sizes[lo]] >= 2):
            best = max(best, total)
        if total <= room:
            lo += 1
        else:
            hi -= 1
    return best


def reduce_by_dominance(n: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fixes sets that no alternative can beat and takes them off ``n``; (lengths, how many such sets).

    For a piece j with room r beside it, {j} is fixed if nothing fits, and {j, k}
    for the largest k that fits if k fills r, or no two pieces fit into r, or no
    three do and no two fill more than k: each other set with j could give its
    further pieces to k's place in another sequence.
    """
    fixed: list[tuple[tuple[int, ...], int]] = []
    again = True
    while again:
        again = False
        for j in range(capacity, 0, -1):
            while n[j]:
                room = capacity - j
                n[j] -= 1  # k must be another piece than j
                k = _largest(n, room) if room else 0
                least = int(np.flatnonzero(n)[0]) if n.any() else capacity + 1
                alone = k == 0
                good = alone or k == room or (3 * least > room and _best_pair(n, room) <= k)
                n[j] += 1
                if not good:
                    break
                many = int(n[j]) if alone else int(n[j]) // 2 if k == j else int(min(n[j], n[k]))
                fixed.append(((j,), many) if alone else ((j, k), many))
                n[j] -= many
                if not alone:
                    n[k] -= many
                again = True
    return fixed


def best_fit(n: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over lengths, all sequences with equal content at once."""
    open_: dict[int, dict[tuple[int, ...], int]] = {}  # room left: content: sequences

    def put(room: int, content: tuple[int, ...], many: int) -> None:
        at = open_.setdefault(room, {})
        at[content] = at.get(content, 0) + many

    for size in range(capacity, 0, -1):
        left = int(n[size])
        while left:
            rooms = [r for r in open_ if r >= size]
            if not rooms:
                each = capacity // size
                full, rest = divmod(left, each)
                if full:
                    put(capacity - each * size, (size,) * each, full)
                if rest:
                    put(capacity - rest * size, (size,) * rest, 1)
                break
            room = min(rooms)
            content, many = next(iter(open_[room].items()))
            each = room // size
            full, rest = divmod(left, each)
            used = min(full, many)
            if used:
                put(room - each * size, content + (size,) * each, used)
                left -= used * each
            extra = 0
            if used < many and left and left < each:
                put(room - left * size, content + (size,) * left, 1)
                left, extra = 0, 1
            if many == used + extra:
                del open_[room][content]
                if not open_[room]:
                    del open_[room]
            else:
                open_[room][content] = many - used - extra
    return [x for at in open_.values() for x in at.items()]


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Columns length, first, last + 1, sequence of the first, offset: where the pieces of each length go."""
    n = np.zeros(capacity + 1, np.int64)
    for size, many in histogram.items():
        n[size] = many
    sets = reduce_by_dominance(n, capacity)
    sets += best_fit(n, capacity)
    given, rows, sequence = np.zeros(capacity + 1, np.int64), [], 0
    for content, many in sets:
        offset = 0
        for size in content:
            rows.append((size, given[size], given[size] + many, sequence, offset))
            given[size] += many
            offset += size
        sequence += many
    rows.sort()
    return np.array(rows, np.int64).reshape(-1, 5)


def numbered(pieces: DataFrame) -> DataFrame:
    """Adds ``_n``: the number of a piece among those of its length, from 0.

    A length may hold a third of all rows, so each is dealt over buckets that
    are numbered apart and then follow one another.
    """
    buckets = max(64, 4 * int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = pieces.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = sizes.select(
        "length", "_b", (F.sum("_c").over(W.partitionBy("length").orderBy("_b").rowsBetween(W.unboundedPreceding, 0)) - F.col("_c")).alias("_o")
    )
    within = F.row_number().over(W.partitionBy("length", "_b").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    return dealt.withColumn("_k", within).join(before, ["length", "_b"]).withColumn("_n", F.col("_k") + F.col("_o")).drop("_k", "_o", "_b")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece with its sequence and place in it."""
    pieces = cut(token_pieces(docs, tokenizer, capacity))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    rows = plan(histogram, capacity)
    wide = int(rows[:, 2].max()) + 1 if len(rows) else 1
    keys = rows[:, 0] * wide + rows[:, 1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            at = np.searchsorted(keys, x["length"].to_numpy() * wide + x["_n"].to_numpy(), side="right") - 1
            x["sequence_id"] = rows[at, 3] + x["_n"].to_numpy() - rows[at, 1]
            x["offset"] = rows[at, 4]
            yield x.drop(columns="_n")

    ordered = numbered(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("_n").cast("bigint").alias("_n"))
    return ordered.mapInPandas(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
