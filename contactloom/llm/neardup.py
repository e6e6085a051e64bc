"""MinHash near-duplicates with sequential Bayesian verification.

1. One pass turns each text into its set of word shingles, a key of the set, and
   a signature of ``BANDS * ROWS`` minima. Texts with equal sets become one set,
   which has a number of its own, whatever doc_ids it comes from.
2. Bands deal the distinct sets into buckets. In each bucket the most central
   member (that with most bucket companions) is compared with the others; links
   join into components, so a large group of near copies costs one comparison a
   member and not one a pair.
3. Sets in buckets that still span several components meet their other candidates
   by an exact filter instead of pair by pair: with the rarest shingles first, two
   sets that reach the threshold share a shingle within a short prefix of each.
   Sets that merely hold the same frequent passage have prefixes of their own and
   never meet; length and place within the prefix exclude the rest. Sharers of a
   frequent prefix shingle are met in blocks of bounded size, and only candidates
   that pass leave a block.
4. A candidate's signatures are compared batch by batch; it is dropped as soon as
   the posterior chance that its similarity reaches the threshold falls below
   ``MISS``. Survivors are verified on their full sets, so every link is exact.

Defined cases: NULL, empty and word-free texts have an empty set and no link; a
text with fewer words than a shingle is one shingle; there is one row for each row
of the input, and repeated rows are judged alike; rows of one doc_id with different
texts are different sets, each named by its own class; a class is named by its
smallest doc_id that is not NULL, so rows without a doc_id are kept only if their
class has none; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, stored

BANDS, ROWS, BATCH, MISS = 24, 4, 16, 1e-6
HASHES = BANDS * ROWS
#: Members of a block of sets that share a prefix shingle: those of the shorter prefix, and of the longer.
INDEXED, PROBING = 256, 4096
_R = np.random.default_rng(20240229)
_BYTE = _R.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = _R.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _R.integers(0, 2**63, HASHES, dtype=np.uint64)
_KEYS = _R.integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _mix(x: np.ndarray, k: int = 0) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _KEYS[k]
    x = (x ^ (x >> np.uint64(29))) * _KEYS[k + 1]
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _KEYS[7], np.uint64)
    p[:1] = 1
    return np.cumprod(p, dtype=np.uint64)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    raw = np.frombuffer((" " + (text or "")).encode("utf-8", "surrogatepass").lower(), np.uint8)
    letter = ~_SPACE[raw]
    starts = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
    if not len(starts):
        return np.empty(0, np.uint64)
    at = np.flatnonzero(letter)
    first = np.searchsorted(at, starts)
    lengths = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, lengths)
    words = _mix(np.add.reduceat(_BYTE[raw[at]] * _powers(int(lengths.max()))[place], first) + lengths.astype(np.uint64))
    n = len(words)
    if n < size:
        out = np.uint64(n)
        for w in words:
            out = _mix(np.array([out * _KEYS[5] + w], np.uint64))[0]
        return np.array([out], np.uint64)
    h = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        h = _mix(h * _KEYS[6] + words[k : n - size + 1 + k], 2)
    return np.unique(h)


def signature(s: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), 8192):
        out = np.minimum(out, (s[None, k : k + 8192] * _MUL[:, None] + _ADD[:, None]).min(axis=1))
    return out


def _sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, t, n, k1, k2 (key of the set), sig (16 bits of each minimum) and bands (bucket of each band)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                n, k1, k2, sigs, bands = [], [], [], [], []
                for t in batch.column(2):
                    s = shingle_set(t.as_py(), size)
                    n.append(len(s))
                    k1.append(int(_mix(s, 3).sum(dtype=np.uint64).astype(np.int64)))
                    k2.append(int(_mix(s, 4).sum(dtype=np.uint64).astype(np.int64)))
                    if not len(s):
                        sigs.append(b"")
                        bands.append(np.empty(0, np.int64))
                        continue
                    sig = signature(s) >> np.uint64(32)
                    sigs.append((sig & np.uint64(0xFFFF)).astype(np.uint16).tobytes())
                    b, h = sig.reshape(-1, ROWS), np.arange(BANDS, dtype=np.uint64)
                    for r in range(ROWS):
                        h = _mix(h * _KEYS[5] + b[:, r], 1)
                    bands.append(h.view(np.int64))
                flat = np.concatenate(bands) if bands else np.empty(0, np.int64)
                offs = np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sigs, pa.binary()), pa.ListArray.from_arrays(offs, flat)],
                    ["doc_id", "t", "n", "k1", "k2", "sig", "bands"],
                )

    return docs.mapInArrow(run, "doc_id bigint, t bigint, n bigint, k1 bigint, k2 bigint, sig binary, bands array<bigint>")


def least_matches(threshold: float, miss: float = MISS) -> list[int]:
    """For each batch the fewest matches so far at which the posterior chance of reaching ``threshold`` is ``miss`` or more.

    With a flat prior, m of n matches leave Beta(m + 1, n - m + 1), whose part from
    the threshold up is the chance of at most m successes in n + 1 trials.
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, 0
        while True:
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                break
            m += 1
        out.append(m)
    return out


def _survivors(a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Indices of the rows of two signature arrays that no batch prunes."""
    alive, hits = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, m in enumerate(least):
        part = slice(k * BATCH, (k + 1) * BATCH)
        hits = hits + (a[alive, part] == b[alive, part]).sum(axis=1)
        ok = hits >= m
        alive, hits = alive[ok], hits[ok]
    return alive


def _sigs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


def _prune(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose signatures may reach the threshold."""
    least = least_matches(percent / 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            na, nb = x.column(2).to_numpy(), x.column(4).to_numpy()
            near = np.flatnonzero(100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
            x = x.take(pa.array(near))
            if x.num_rows:
                x = x.take(pa.array(_survivors(_sigs(x.column(3)), _sigs(x.column(5)), least)))
            yield x.select(["a", "b"])

    r = reps.select("sid", "n", "sig")
    both = pairs.join(r.toDF("a", "na", "sa"), "a").join(r.toDF("b", "nb", "sb"), "b").select("a", "b", "na", "sa", "nb", "sb")
    return both.mapInArrow(run, "a bigint, b bigint")


def _texts(docs: DataFrame, names: DataFrame, *more: str) -> DataFrame:
    """(..., text) of the sets in ``names``, told by the doc_id and text key of a row that has them."""
    d = docs.select(F.col("doc_id").alias("_d"), F.col("t").alias("_t"), "text")
    return names.join(d, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("t") == F.col("_t"))).select(*more, "text")


def _verify(pairs: DataFrame, docs: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets meet ``100 * intersection >= percent * union``; ``b`` may be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, t = None, np.empty(0, np.uint64)
        with np.errstate(over="ignore"):
            for x in batches:
                good = []
                for k, (b, p, q) in enumerate(zip(x.column(1).to_pylist(), x.column(2), x.column(3), strict=True)):
                    if b != last:  # rows come sorted by b for the most part
                        last, t = b, shingle_set(q.as_py(), size)
                    s = shingle_set(p.as_py(), size)
                    at = np.searchsorted(t, s)
                    both = int((t[np.minimum(at, len(t) - 1)] == s).sum())
                    if 100 * both >= percent * (len(s) + len(t) - both):
                        good.append(k)
                yield x.take(pa.array(good, pa.int64())).select(["a", "b"])

    name = reps.select("sid", "doc_id", "t")
    left = _texts(docs, pairs.join(name.withColumnRenamed("sid", "a"), "a"), "a", "b").withColumnRenamed("text", "p")
    right = _texts(docs, pairs.select("b").distinct().join(name.withColumnRenamed("sid", "b"), "b"), "b").withColumnRenamed("text", "q")
    return left.join(right.hint("merge"), "b").select("a", "b", "p", "q").mapInArrow(run, "a bigint, b bigint").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over links (a, b), by alternating star contraction."""
    edges = cut(links.select("a", "b").where("a <> b").distinct())
    seen = None
    while True:
        both = edges.union(edges.select("b", "a"))  # large stars: larger neighbours move to the smallest
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))  # small stars: smaller ones too
        small = down.groupBy("a").agg(F.min("b").alias("m"))
        edges = cut(
            down.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
            .union(small.select("a", F.col("m").alias("b"))).distinct()
        )
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    return edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component").union(
        edges.select("b", "b").distinct().toDF("id", "component")
    )


def _prefixes(docs: DataFrame, named: DataFrame, size: int, percent: int) -> DataFrame:
    """(w, sid, comp, n, pos, indexed): the shared shingles within the prefix of each set, the rarest first."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in batches:
                found = [shingle_set(t.as_py(), size).view(np.int64) for t in b.column(2)]
                offs = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                flat = np.concatenate(found) if found else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(offs, flat)], ["sid", "comp", "s"])

    held = stored(_texts(docs, named, "sid", "comp").dropDuplicates(["sid"]).mapInArrow(sets, "sid bigint, comp bigint, s array<bigint>"))
    rows = held.select("sid", "comp", F.size("s").cast("bigint").alias("n"), F.explode("s").alias("w"))
    often = rows.groupBy("w").agg(F.count(F.lit(1)).alias("c")).where("c > 1")  # a shingle of one set meets nothing
    own = W.partitionBy("sid")
    rows = rows.join(often, "w").withColumn("pos", F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("c", "w")) - 1)
    n = F.col("n")
    long, short = n - F.ceil(n * percent / 100) + 1, n - F.ceil(n * 2 * percent / (100 + percent)) + 1
    return rows.where(F.col("pos") < long).select("w", "sid", "comp", "n", "pos", (F.col("pos") < short).alias("indexed"))


def _meeting(percent: int):
    """Pairs of a block's sets, of different components, whose lengths and prefix places allow the threshold."""

    def run(x: pa.Table) -> pa.Table:
        sid, comp, n, pos, indexed = (x.column(k).to_numpy() for k in ("sid", "comp", "n", "pos", "indexed"))
        y = np.flatnonzero(indexed)
        y = y[np.argsort(n[y], kind="stable")]
        probe = np.flatnonzero(~indexed)
        out: list[np.ndarray] = []
        # a partner has at most as many shingles, and what is left from the shared one on must still suffice
        most = np.minimum(n[probe], ((100 + percent) * (n[probe] - pos[probe]) - percent * n[probe]) // percent)
        lo = np.searchsorted(n[y], -(-percent * n[probe] // 100))
        many = np.maximum(np.searchsorted(n[y], most, side="right") - lo, 0)
        ends = np.cumsum(many)
        k = 0
        while k < len(probe):
            e = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + (1 << 20), side="right")))
            m = many[k:e]
            p = np.repeat(probe[k:e], m)
            q = y[np.repeat(lo[k:e] - np.cumsum(m) + m, m) + np.arange(int(m.sum()))]
            need = -(-percent * (n[p] + n[q]) // (100 + percent))
            ok = (comp[p] != comp[q]) & (n[q] - pos[q] >= need)
            out.append(np.stack([np.minimum(sid[p[ok]], sid[q[ok]]), np.maximum(sid[p[ok]], sid[q[ok]])], axis=1))
            k = e
        found = np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), np.int64)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    return run


def _across(members: DataFrame, docs: DataFrame, reps: DataFrame, comp: DataFrame, size: int, percent: int) -> DataFrame:
    """Candidates (a, b) of different components among the sets whose buckets span several."""
    m = members.join(comp.withColumnRenamed("id", "sid"), "sid", "left").withColumn("comp", F.coalesce("component", "sid"))
    open_ = m.groupBy("h").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("h")
    named = m.join(open_, "h").select("sid", "comp").distinct().join(reps.select("sid", "doc_id", "t"), "sid")
    rows = stored(_prefixes(docs, named, size, percent))
    sizes = rows.groupBy("w").agg(F.count(F.lit(1)).alias("np"), F.count_if("indexed").alias("ni"), F.min("comp").alias("x"), F.max("comp").alias("y"))
    sizes = sizes.where("ni > 0 AND np > 1 AND x <> y").select(
        "w", F.ceil(F.col("ni") / INDEXED).cast("int").alias("bi"), F.ceil(F.col("np") / PROBING).cast("int").alias("bp")
    )
    rows = rows.join(sizes, "w")
    at = lambda b: F.pmod(F.xxhash64("sid", "w"), F.col(b)).cast("int")
    every = lambda b: F.explode(F.sequence(F.lit(0), F.col(b) - 1))
    cols = ["sid", "comp", "n", "pos"]
    index = rows.where("indexed").select("w", at("bi").alias("i"), every("bp").alias("p"), *cols, F.lit(True).alias("indexed"))
    probe = rows.select("w", at("bp").alias("p"), every("bi").alias("i"), *cols, F.lit(False).alias("indexed"))
    blocks = index.unionByName(probe)
    return blocks.groupBy("w", "i", "p").applyInArrow(_meeting(percent), "a bigint, b bigint").distinct()


def classes(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, t (key of the text), n_shingles, component_id, kept: a row for each row of the input."""
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text)).alias("t"), F.col(text).alias("text"))
    base = stored(_sketches(docs, size).withColumn("r", F.monotonically_increasing_id()))
    sets = stored(base.where("n > 0").groupBy("n", "k1", "k2").agg(F.min("r").alias("sid"), F.min("doc_id").alias("least")))
    reps = stored(base.join(sets.select(F.col("sid").alias("r")), "r").select(F.col("r").alias("sid"), "doc_id", "t", "n", "sig", "bands"))
    members = reps.select("sid", F.explode("bands").alias("h"))
    shared = members.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    members = stored(members.join(shared, "h"))
    central = members.join(members.groupBy("sid").agg(F.sum("c").alias("w")), "sid")
    pivots = central.groupBy("h").agg(F.max(F.struct("w", (-F.col("sid")).alias("s"))).alias("top")).select("h", (-F.col("top.s")).alias("b"))
    stars = members.join(pivots, "h").where("sid <> b").select(F.col("sid").alias("a"), "b").distinct()
    links = stored(_verify(stored(_prune(stars, reps, percent)), docs, reps, size, percent))
    comp = cut(components(links))
    rest = stored(_prune(_across(members, docs, reps, comp, size, percent), reps, percent))
    if rest.limit(1).count():
        comp = cut(components(links.union(_verify(rest, docs, reps, size, percent))))
    named = sets.join(comp.withColumnRenamed("id", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("n", "k1", "k2", "component_id")
    out = base.select("doc_id", "t", "n", "k1", "k2").join(named, ["n", "k1", "k2"], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "t", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of the input."""
    return classes(docs, size, percent, doc_id, text).drop("t")


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, that with the smallest doc_id, with its own columns; of rows that repeat a doc_id and text one stays."""
    judged = classes(docs, size, percent).groupBy("doc_id", "t").agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("many"))
    judged = judged.where("NOT kept OR many > 1").select(F.col("doc_id").alias("_d"), F.col("t").alias("_t"), "kept")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("bigint").alias("_doc"), F.xxhash64("text").alias("_text"))
    at = F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_text") == F.col("_t"))
    alone = row.join(judged, at, "left_anti").select("_row")
    repeated = row.join(judged.where("kept"), at).groupBy("_doc", "_text").agg(F.first("_row").alias("_row")).select("_row")
    return alone.union(repeated).select("_row.*")
