"""Work that must not grow faster than the input: how often inputs are made, and what is shuffled."""

import numpy as np
import pytest

from contactloom.operators import matrix as M
from test_units import pixels


def counted(spark, df):
    """``df`` and an accumulator of the rows of it that were made."""
    n = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            n.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), n


def symmetric(n, seed=1):
    m = np.random.default_rng(seed).integers(1, 9, (n, n)).astype(float)
    return m + m.T


def test_packed_rows_multiply(spark):
    m = symmetric(300)
    ids, sums, blocks = M.packed_rows(pixels(spark, m))
    assert list(ids) == list(range(300)) and np.allclose(sums, m.sum(1))
    v = np.linspace(1, 2, 300)
    got, seen = M.rows_times(blocks, v)
    assert np.allclose(got, m @ v) and seen.all()


@pytest.mark.parametrize("how", [M.balance, M.ice])
def test_balancing_makes_its_pixels_twice(spark, how):
    px, n = counted(spark, pixels(spark, symmetric(8)))
    how(px, 10).count()
    assert n.value <= 2 * 36


def test_bins_of_absent_pixels_have_no_bias(spark):
    empty = pixels(spark, np.zeros((3, 3)))
    assert M.ice(empty).count() == 0 and M.balance(empty).count() == 0


def test_homer_is_compressed_and_whole(spark, tmp_path):
    from contactloom.sources import text
    from test_units import bins

    m = np.zeros((400, 400))
    m[0, 399] = m[7, 7] = 2.0
    m[0, 0], m[3, 200] = 0.5, 10.0
    path = text.write_homer(pixels(spark, m), bins(spark, 400), f"file://{tmp_path}/homer")
    rows = spark.read.text(path).where("value NOT LIKE 'HiCMatrix%'").collect()
    assert sorted(len(r[0].split("\t")) for r in rows) == [402] * 400
    got = {(r["start1"] // 10, r["start2"] // 10): r["value"] for r in text.read_homer(spark, path).collect()}
    assert got == {(i, j): m[i, j] for i, j in zip(*np.nonzero(m), strict=True)}
    assert sum(f.stat().st_size for f in (tmp_path / "homer").iterdir()) < 400 * 400


def test_rounding_is_that_of_the_statements(spark):
    import duckdb

    from contactloom.plans import features, matrices

    values = [k / 2000 + 0.0000005 for k in range(-2000, 2000)]
    want = [r[0] for r in duckdb.connect().execute("SELECT round(unnest(?::DOUBLE[]), 6)", [values]).fetchall()]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, value double").coalesce(1)
    assert [r["value"] for r in features._r(df, "value").orderBy("k").collect()] == want
    assert [r["value"] for r in matrices._r(df).orderBy("k").collect()] == want


def test_relation_lines_of_ids_that_two_chromosomes_share(spark):
    from contactloom.operators import chains as C
    from contactloom.operators import features as X

    d = spark.createDataFrame([(c, s, e, i) for c in (1, 2) for s, e, i in ((0, 100, 1), (10, 60, 2))], "chrom bigint, start bigint, end bigint, id bigint")
    got = sorted(tuple(r) for r in C.relation_lines(X.domain_relations(d)).collect())
    assert got == [(1, '"1" -> "2";'), (2, '"1" -> "2";')]


@pytest.mark.parametrize("mode", ["intra-chr", "inter-chr", "all"])
def test_anchor_pairs_shuffle_bins_not_pairs(spark, mode):
    from contactloom.operators import chains as C

    rng = np.random.default_rng(3)
    sides = [[(int(r), int(b) // 40, int(b) // 40 * 1_000_000 + int(b) % 40, "+-"[r % 2]) for r, b in zip(rng.permutation(60), rng.integers(0, 80, 60), strict=True)] for _ in range(2)]
    a, b = (spark.createDataFrame(s, "row bigint, chrom bigint, bin_id bigint, strand string") for s in sides)
    want = {}
    for ra, ca, x, sa in sides[0]:
        for rb, cb, y, sb in sides[1]:
            if x != y and {"intra-chr": ca == cb and 4 <= abs(x - y) <= 20, "inter-chr": ca != cb, "all": True}[mode]:
                new = ((ra, rb), sb + sa if x > y else sa + sb)
                want[min(x, y), max(x, y)] = min(want.get((min(x, y), max(x, y)), new), new)
    out = C.anchor_pairs(a, b, mode, 4, 20)
    rows = out.collect()
    assert {(r["bin1"], r["bin2"]): r["strands"] for r in rows} == {k: v[1] for k, v in want.items()} and len(rows) == len(want)
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_dense_stretch_of_loops_against_brute_force(spark):
    from contactloom.operators import features as X

    rng = np.random.default_rng(9)
    every = sorted({("a", s, s + 1000, "a", s + 20_000, s + 20_000 + 500 * w) for s, w in zip(rng.integers(0, 40_000, 1500).tolist(), rng.integers(1, 8, 1500).tolist(), strict=True)})
    order = lambda x: (x[5] - x[4], -x[1], -x[4], -x[2])
    near = lambda x, y: x[1] - 2000 < y[2] and y[1] < x[2] + 2000 and x[4] - 2000 < y[5] and y[4] - 2000 < x[5]
    want = sorted(x for x in every if not any(near(x, y) and order(y) > order(x) for y in every))
    df = spark.createDataFrame(every, "chrom1 string, start1 bigint, end1 bigint, chrom2 string, start2 bigint, end2 bigint")
    out = X.merge_loops(df, 2000)
    assert sorted(map(tuple, out.collect())) == want
    assert "FlatMapGroupsInArrow" in out._jdf.queryExecution().optimizedPlan().toString()  # no join that makes pairs


def test_mates_are_dealt_by_the_size_of_their_files(spark, monkeypatch):
    from contactloom import frames
    from contactloom.sources import tables as T

    monkeypatch.setattr(frames, "PART", 1 << 12)
    few = T.pixels(spark, "/root/testdata/sf0.001").rdd.getNumPartitions()
    monkeypatch.setattr(frames, "PART", 1 << 10)
    assert T.pixels(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 2 * few


def test_dense_cells_are_not_shuffled(spark):
    """One row per bin and tile of columns leaves a task; a test of values is in test_units."""
    m = symmetric(150, 5)
    m[:, 7] = m[7, :] = 0
    from test_units import bins

    out = M.covariance(pixels(spark, m), bins(spark, 150), tile=64)
    got = {(r["bin1"], r["bin2"]): r["value"] for r in out.collect()}
    want = np.cov(m)
    assert len(got) == 150 * 151 // 2 and all(abs(v - want[k]) < 1e-9 for k, v in got.items())
    assert out._jdf.queryExecution().optimizedPlan().toString().lstrip().startswith(("Project", "Generate"))
