"""Nearest neighbours by largest inner product over an inverted multi-index.

Each half of a vector is quantised by its own code book, so K + K centroids make
K * K cells. A query walks the cells from the best sum of its two half products
down, with a heap over pairs, until the cells met hold a share of all
vectors; those are ranked by the exact product in double precision.

The code books come from a sample of at most ``SAMPLE`` vectors, and so does the
share: the least of ``SHARES`` that finds ``RECALL`` of the true neighbours of ``ASKED``
sampled queries within the sample. Vectors in clusters need a few hundredths of the
cells; directions without any structure need half of them, whatever the index. Every
vector is indexed. Cells are cut or joined into blocks of even size by their counts
(K * K numbers); a block's vectors meet the queries that reach it once, or once for
every ``QUERIES`` of them, and only the best of a block leave it, so a frequent vector is
spread and nothing is collected but counts. Vectors of different lengths are
different tables: each length has its own index and neighbours of its own length.

Defined cases: vectors that are NULL, zero, or hold NULL or non-finite parts take no
part, nor do rows without an id; equal rows are told apart by vec_id; rows that repeat
a vec_id are rows of their own, as queries (each with its own ranks from 1) and as
candidates of the same name; lengths are told apart up to ``LENGTHS`` of them, the most
frequent first; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

K, SAMPLE, ROUNDS = 64, 20_000, 12
SHARES, RECALL, ASKED = (0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 1.0), 0.94, 200
BLOCK, QUERIES = 8192, 16_384
LENGTHS = 16


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """id, v (doubles) and row (a number of its own) of the vectors that take part."""
    v = F.col("v")
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    rows = rows.where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.where(~F.exists(v, bad) & F.exists(v, lambda x: x != 0)).withColumn("row", F.monotonically_increasing_id())


def code_book(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Centroids of one half by Lloyd's rounds; no more of them than different vectors."""
    x = np.asarray(x)
    different = np.unique(x, axis=0)
    k = min(k, len(different))
    c = different[np.random.default_rng(seed).choice(len(different), k, replace=False)]
    for _ in range(ROUNDS):
        at = _nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        n = np.bincount(at, minlength=k)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmax(x @ c.T - 0.5 * (c * c).sum(axis=1), axis=1)


def walk(p: np.ndarray, q: np.ndarray, counts: np.ndarray, need: int) -> list[tuple[int, int]]:
    """Cells from the largest p[i] + q[j] down until ``need`` vectors are met."""
    a, b = np.argsort(-p, kind="stable"), np.argsort(-q, kind="stable")
    p, q = p[a].tolist(), q[b].tolist()
    heap, seen, met, out = [(-p[0] - q[0], 0, 0)], [0] * len(p), 0, []
    seen[0] = 1  # seen[i]: how far row i has been pushed
    while heap and met < need:
        _, i, j = heapq.heappop(heap)
        if n := int(counts[a[i], b[j]]):
            met += n
            out.append((int(a[i]), int(b[j])))
        if j + 1 < len(q) and seen[i] == j + 1:
            heapq.heappush(heap, (-p[i] - q[j + 1], i, j + 1))
            seen[i] = j + 2
        if j == 0 and i + 1 < len(p):
            heapq.heappush(heap, (-p[i + 1] - q[0], i + 1, 0))
            seen[i + 1] = 1
    return out


def blocks_of(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """First block and number of blocks of each cell, and the number of all blocks."""
    first, many = np.zeros(counts.shape, np.int64), np.ones(counts.shape, np.int64)
    block, held = 0, 0
    for cell, n in np.ndenumerate(counts):
        if n > size:
            block += held > 0
            first[cell], many[cell] = block, -(-n // size)
            block, held = block + many[cell], 0
            continue
        if held and held + n > size:
            block, held = block + 1, 0
        first[cell] = block
        held += n
    return first, many, int(block + (held > 0))


def least_share(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], top: int) -> float:
    """The least share of the cells' vectors that finds ``RECALL`` of the true neighbours within the sample ``x``."""
    half = books[0].shape[1]
    cells = _cells(x, books)
    counts = np.zeros((len(books[0]), len(books[1])), np.int64)
    np.add.at(counts, cells, 1)
    asked = x[:: max(1, len(x) // ASKED)][:ASKED]
    # the place in the walk at which each cell is reached, as a share of all vectors
    hits, shares = np.zeros(len(SHARES)), np.array(SHARES)
    for v in asked:
        true = np.argsort(-(x @ v), kind="stable")[: top + 1]
        reached = np.full(counts.shape, np.inf)
        met = 0
        for c in walk(books[0] @ v[:half], books[1] @ v[half:], counts, len(x)):
            reached[c] = met / len(x)  # the walk goes on while less than the share is met
            met += counts[c]
        at = reached[cells[0][true], cells[1][true]]
        hits += (at[:, None] < shares[None, :]).mean(axis=0)
    good = np.flatnonzero(hits / len(asked) >= RECALL)
    return float(shares[good[0]]) if len(good) else 1.0


def _cells(x: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    half = books[0].shape[1]
    c = [_nearest(part, b) if part.shape[1] else np.zeros(len(x), np.int64) for part, b in zip((x[:, :half], x[:, half:]), books, strict=True)]
    return c[0], c[1]


def nearest(vectors: DataFrame, every: int = 20, top: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, share: float | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` best of all other rows for each row whose id ``every`` divides."""
    rows = cut(usable(vectors, vec_id, embedding))
    lengths = [r["d"] for r in rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(LENGTHS).collect()]
    parts = [_nearest_of_length(rows.where(F.size("v") == d), d, every, top, k, share) for d in lengths]
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


def _nearest_of_length(rows: DataFrame, length: int, every: int, top: int, k: int, share: float | None) -> DataFrame:
    half = max(1, length // 2)
    sample = rows.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).select("v").toPandas()["v"]  # a bounded sample, for the code books and the share alone
    x = np.stack([np.asarray(v, float) for v in sample])
    books = code_book(x[:, :half], k, 1), code_book(x[:, half:], k, 2) if length > half else np.zeros((1, 0))
    if share is None:
        share = least_share(x, books, top)
    width = len(books[1])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c1, c2 = _cells(_matrix(b.column(1)), books)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(c1 * width + c2, pa.int64())], ["id", "v", "row", "cell"])

    indexed = cut(rows.select("id", "v", "row").mapInArrow(index, "id bigint, v array<double>, row bigint, cell bigint"))
    counts = np.zeros((len(books[0]), width), np.int64)
    for r in indexed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():  # at most k * k rows
        counts[divmod(r["cell"], width)] = r["n"]
    total = int(counts.sum())
    first, many, _ = blocks_of(counts, min(BLOCK, max(1, -(-total // 16))))
    need = max(top + 1, int(np.ceil(share * total)))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A query once for each block that holds one of its cells, with those cells."""
        for b in batches:
            out = []
            for i, v, row in zip(b["id"], b["v"], b["row"], strict=True):
                v = np.asarray(v, float)
                at: dict[int, list[int]] = {}
                for c in walk(books[0] @ v[:half], books[1] @ v[half:], counts, need):
                    for n in range(many[c]):
                        at.setdefault(int(first[c]) + n, []).append(c[0] * width + c[1])
                out += [(block, i, v, row, cells) for block, cells in at.items()]
            yield pd.DataFrame(out, columns=["block", "id", "v", "row", "cells"])

    asks = cut(indexed.where(F.col("id") % every == 0).select("id", "v", "row").mapInPandas(ask, "block bigint, id bigint, v array<double>, row bigint, cells array<bigint>"))
    shares = asks.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("parts"))  # a row for each block
    asks = asks.join(shares, "block").withColumn("q", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).withColumn("cell", F.lit(-1).cast("bigint"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector with its block."""
        for b in batches:
            at = divmod(b.column(3).to_numpy(), width)
            salt = pd.util.hash_array(b.column(2).to_numpy().astype(np.int64)) % many[at].astype(np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(first[at] + salt.astype(np.int64), pa.int64())], ["id", "v", "row", "cell", "block"])

    dealt = indexed.mapInArrow(deal, "id bigint, v array<double>, row bigint, cell bigint, block bigint")
    base = dealt.join(shares, "block").withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("cells", F.lit(None).cast("array<bigint>"))
    columns = ["block", "q", "id", "v", "row", "cell", "cells"]

    def best(t: pa.Table) -> pa.Table:
        cell, ids, row = (t.column(x).to_numpy() for x in ("cell", "id", "row"))
        base, asks = np.flatnonzero(cell >= 0), np.flatnonzero(cell < 0)
        out: list[tuple[np.ndarray, ...]] = []
        if len(base) and len(asks):
            v = _matrix(t.column("v").combine_chunks())
            # by cell, so that a query reads slices of the block
            base = base[np.argsort(cell[base], kind="stable")]
            e, names, numbers, cells = v[base], ids[base], row[base], cell[base]
            for a in asks:
                own = np.array(t.column("cells")[int(a)].as_py(), np.int64)
                lo, hi = np.searchsorted(cells, own), np.searchsorted(cells, own, side="right")
                ok = np.concatenate([np.arange(x, y) for x, y in zip(lo, hi, strict=True)])
                ok = ok[numbers[ok] != row[a]]
                # the same order of additions for every pair: equal vectors get equal scores
                z = np.einsum("nd,d->n", e[ok], v[a])
                if len(ok) > top:
                    keep = z >= np.partition(z, len(z) - top)[len(z) - top]
                    ok, z = ok[keep], z[keep]
                order = np.lexsort((numbers[ok], names[ok], -z))[:top]
                out.append((np.full(len(order), ids[a]), np.full(len(order), row[a]), names[ok][order], numbers[ok][order], z[order]))
        kinds = (np.int64, np.int64, np.int64, np.int64, float)
        got = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, kind) for kind in kinds]
        return pa.table(dict(zip(("query_id", "_query", "vec_id", "_row", "score"), got, strict=True)))

    found = base.select(columns).union(asks.select(columns)).groupBy("block", "q").applyInArrow(best, "query_id bigint, _query bigint, vec_id bigint, _row bigint, score double")
    rank = F.row_number().over(W.partitionBy("query_id", "_query").orderBy(F.desc("score"), "vec_id", "_row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, float).reshape(len(column), -1)
