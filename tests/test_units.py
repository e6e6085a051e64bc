import math

import numpy as np
import pytest

from contactloom.frames import STRIDE
from contactloom.functions import stats
from contactloom.operators import bins as B
from contactloom.operators import chains as C
from contactloom.operators import features as X
from contactloom.operators import intervals as I
from contactloom.operators import matrix as M
from contactloom.operators import pairs as P

IV = "chrom string, start bigint, end bigint"


def got(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def pixels(spark, m):
    return spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(m) for j, v in enumerate(row) if i <= j and v], "bin1 bigint, bin2 bigint, value double")


def bins(spark, n, size=10):
    return spark.createDataFrame([(k, 0, k * size, (k + 1) * size) for k in range(n)], "bin_id bigint, chrom bigint, start bigint, end bigint")


def test_restriction_bins(spark):
    sites = spark.createDataFrame([("1", 10, 20), ("1", 60, 70), ("2", 20, 30), ("2", 40, 50), ("2", 70, 80)], IV)
    sizes = spark.createDataFrame([("1", 100), ("2", 100)], "chrom string, size bigint")
    assert got(B.restriction_bins(sites, sizes, 10, 20)) == [("1", 0, 40), ("1", 40, 90), ("2", 0, 60), ("2", 60, 100)]


def test_enlarge(spark):
    b = spark.createDataFrame([("1", 10, 30), ("1", 50, 80), ("2", 10, 60), ("2", 60, 90)], IV)
    assert got(B.enlarge(b)) == [("1", 0, 40), ("1", 40, 80), ("2", 0, 60), ("2", 60, 90)]
    sizes = spark.createDataFrame([("1", 100), ("2", 100)], "chrom string, size bigint")
    assert got(B.enlarge(b, sizes)) == [("1", 0, 40), ("1", 40, 100), ("2", 0, 60), ("2", 60, 100)]


def test_restriction_sites(spark):
    s = spark.createDataFrame([("c", "AAGTACTTCGTACC"), ("e", ""), ("n", None)], "chrom string, seq string")
    assert got(B.restriction_sites(s, ["GTAC"])) == [("c", 2, 6, "+"), ("c", 9, 13, "+")]
    assert got(B.restriction_sites(spark.createDataFrame([("c", "CTTCGTTCGAAG")], "chrom string, seq string"), ["CG.AG"])) == [("c", 0, 5, "-"), ("c", 7, 12, "+")]


def test_running_window(spark):
    x = {(r[0], r[1]): r[2] for r in M.running_window(pixels(spark, np.ones((4, 4))), bins(spark, 4), 3).collect()}
    assert [[x[i, j] for j in range(i, 4)] for i in range(4)] == [[3, 5, 6, 4], [6, 8, 6], [6, 5], [3]]


def test_reduce(spark):
    m = np.ones((6, 6))
    g = spark.createDataFrame([(k, k // 2) for k in range(6)], "bin_id bigint, group bigint")
    x = {(r[0], r[1]): r[2] for r in M.reduce(pixels(spark, m), g).collect()}
    assert x == {(0, 0): 3, (1, 1): 3, (2, 2): 3, (0, 1): 4, (0, 2): 4, (1, 2): 4}


def test_balance_rows_sum_to_one(spark):
    rng = np.random.default_rng(1)
    m = rng.integers(1, 9, (6, 6)).astype(float)
    px = pixels(spark, m + m.T)
    s = M.marginals(M.apply_bias(px, M.balance(px, 60))).collect()
    assert all(abs(r["total"] - 1) < 1e-4 for r in s)


def test_pick_supplementary(spark):
    a = spark.createDataFrame([("r", 0, "c", 10, "10S1D25M"), ("r", 2048, "c", 87, "1S34M"), ("r", 2048, "c", 5, "5S30M")], "read_id string, flag int, chrom string, pos bigint, cigar string")
    assert got(P.pick_supplementary(a), "pos") == [(87,)]


def test_duplicates(spark):
    row = lambda k, p: (k, 1, 5, 60, False, 0, p, 9, 60, True, 0)
    df = spark.createDataFrame([row(1, 2), row(2, 2), row(3, 3)], "read_id int, chrom1 int, pos1 int, mapq1 int, rev1 boolean, flag1 int, chrom2 int, pos2 int, mapq2 int, rev2 boolean, flag2 int")
    assert got(P.deduplicate(df), "read_id") == [(1,), (3,)]


def test_intervals_against_loops(spark):
    rng = np.random.default_rng(3)
    a = [(str(rng.integers(2)), int(s), int(s + n)) for s, n in zip(rng.integers(0, 3000, 80), rng.integers(1, 400, 80), strict=True)]
    b = [(str(rng.integers(2)), int(s), int(s + n)) for s, n in zip(rng.integers(0, 3000, 60), rng.integers(1, 900, 60), strict=True)]
    x, y = spark.createDataFrame(a, IV), spark.createDataFrame(b, IV)
    want = sorted((*p, *q) for p in a for q in b if p[0] == q[0] and p[1] < q[2] and q[1] < p[2])
    assert got(I.range_join(x, y, 100), "l.*", "r.*") == want
    assert got(I.overlap_count(x, y, 100)) == sorted((*p, sum(p == w[:3] for w in want) // a.count(p)) for p in a)
    assert I.range_join(x.limit(0), y).count() == 0 and I.merge(x.limit(0)).count() == 0


def test_statistics(spark):
    assert stats.beta_share(1, 4, 0.3) == pytest.approx(1 - 0.7**4)
    assert stats.fisher(3, 1, 1, 3) == pytest.approx(0.4857142857)
    size, prob, total = 2.5, 0.4, 0.0
    for k in range(6):
        total += math.exp(math.lgamma(k + size) - math.lgamma(size) - math.lgamma(k + 1) + size * math.log(prob) + k * math.log(1 - prob))
    assert stats.nb_cdf(5, size, prob) == pytest.approx(total)
    x = np.random.default_rng(5).negative_binomial(4, 0.3, 20_000)
    r, p = stats.nb_fit(x)
    assert abs(r - 4) < 0.4 and abs(p - 0.3) < 0.03
    a, b = np.array([1.0, 2, 2, 5]), np.array([2.0, 3, 6, 7, 7])
    df = spark.createDataFrame([(1, float(v), 1) for v in a] + [(1, float(v), 2) for v in b], "k int, value double, side int")
    row = X.rank_sum(df, ["k"]).first()
    assert (row["z"], row["p"]) == pytest.approx(stats.rank_sum(a, b))


def test_windows():
    assert B.windows(20_000, 140_000, 10_000) == [20_000, 30_000, 48_284, 71_961, 100_000, 131_803]


def test_covariance_is_dense(spark):
    rng = np.random.default_rng(2)
    for m in (np.diag([2.0, 3, 1]), np.triu(rng.integers(0, 3, (7, 7)).astype(float))):
        full = m + m.T - np.diag(np.diag(m))
        px, b = pixels(spark, full), bins(spark, len(full))
        for pearson, want in ((False, np.cov(full)), (True, np.nan_to_num(np.corrcoef(full)))):
            got_ = {(r[0], r[1]): r[2] for r in M.covariance(px, b, pearson).collect()}
            assert got_.keys() == {(i, j) for i in range(len(full)) for j in range(i, len(full))}
            assert all(abs(v - want[k]) < 1e-9 for k, v in got_.items())


def test_row_products_in_tiles(spark):
    m = np.random.default_rng(4).integers(0, 3, (11, 11)).astype(float)
    m = m + m.T
    want = m @ m.T
    got_ = {(r[0], r[1]): r[2] for r in M.row_products(pixels(spark, m), bins(spark, 11), tile=4).collect()}
    assert all(abs(got_.get((i, j), 0.0) - want[i, j]) < 1e-9 for i in range(11) for j in range(i, 11))


def test_power_iteration_equals_dense_algebra(spark):
    rng = np.random.default_rng(6)
    sign = np.repeat([1.0, -1.0], 5)
    m = 6 + 3 * np.outer(sign, sign) + rng.integers(0, 2, (10, 10))
    px, b = pixels(spark, m + m.T), bins(spark, 10)
    dense = {(r["bin_id"], r["k"]): r["value"] for r in X.eigenvectors(px, b, 1).collect()}
    power = {(r["bin_id"], r["k"]): r["value"] for r in X.eigenvectors(px, b, 1, dense=0).collect()}
    assert dense.keys() == power.keys() and all(abs(dense[k] - power[k]) < 1e-4 for k in dense)


def test_valleys_by_hand(spark):
    y = [5, 3, 1, 3, 5, 4, 2, 0, 2, 4, 6, 5, 3, 1, 2, 4, 6, 7, 7, 7, 7, 7]
    s = spark.createDataFrame([(c * STRIDE + k, float(v)) for c in (1, 2) for k, v in enumerate(y)], "bin_id bigint, score double")
    # low places are 2, 7 and 13, high ones 4 and 10; the very first is not kept
    one = [(STRIDE + k, "valley") for k in (7, 13)] + [(STRIDE + k, "peak") for k in (4, 10)]
    two = [(2 * STRIDE + k, "valley") for k in (2, 7, 13)] + [(2 * STRIDE + k, "peak") for k in (4, 10)]
    assert got(X.valleys(s), "bin_id", "kind") == sorted(one + two)
    assert X.valleys(s.limit(0)).count() == 0


def test_weighted_fit_equals_repeated_values():
    v, c = np.array([0, 1, 2, 5]), np.array([7, 4, 3, 1])
    assert stats.nb_fit(v, c) == pytest.approx(stats.nb_fit(np.repeat(v, c)))


def test_arrow_functions_keep_rows_and_nulls(spark):
    df = spark.createDataFrame([(1.0,), (None,), (1.0,), (2.5,), (None,)], "z double")
    want = [math.erfc(1 / math.sqrt(2)), None, math.erfc(1 / math.sqrt(2)), math.erfc(2.5 / math.sqrt(2)), None]
    for x, y in zip([r[0] for r in df.coalesce(1).select(stats.p_of_z("z")).collect()], want, strict=True):
        assert x == (None if y is None else pytest.approx(y))


def test_linkage_order():
    d = [[0, 9, 1, 9], [9, 0, 9, 2], [1, 9, 0, 9], [9, 2, 9, 0]]
    assert C.linkage_order(d) == [0, 2, 1, 3] and C.linkage_order([]) == []


def test_labels_and_models_without_both_classes(spark):
    f = spark.createDataFrame([(k, [float(k)]) for k in range(5)], "bin_id bigint, features array<double>")
    assert X.train_boundaries(f, f.limit(0)) is None
    assert {r["boundary"] for r in X.predict_boundaries(None, f).collect()} == {0}
    rows = f.selectExpr("*", "0.0 AS label")
    assert C.bag_of_boosted(C.undersampled(rows)) == [] and C.vote([], f).count() == 5


def test_stored_or_made(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert C.stored_or_made(spark, f"file://{tmp_path}/scores", make).count() == 3
    assert made == [1]


def test_text_readers(spark, tmp_path):
    from contactloom.sources import text

    at = f"{tmp_path}/x.bed"
    (tmp_path / "x.bed").write_text("# c\ntrack a\nbrowser b\n\nchr1\t5\t9\tn\t1.5\t+\nchr1\tx\t9\tn\t.\t-\n")
    rows = text.read_bed(spark, at, 6).collect()
    assert [(r["start"], r["score"]) for r in rows] == [(5, 1.5), (None, None)] and text.bed_width(spark, at) == 6
    with pytest.raises(ValueError):
        text.read_bed(spark, at, 5)
    assert text.parse_region("chr2:10:1,001,:1000") == ("chr2", 10, 1001, 1000) and text.parse_region("3") == ("3", 0, None, None)
    with pytest.raises(ValueError):
        text.parse_region("1:9-5")
    assert [text.axis_label(x) for x in (5, 2_500, 3e6)] == ["5 b", "2.50 Kb", "3.00 Mb"]


def test_folded_letters(spark):
    from contactloom.functions.strings import ascii_folded

    assert [r[0] for r in spark.createDataFrame([("é漢ö",), (None,)], "s string").coalesce(1).select(ascii_folded("s")).collect()] == ["eo", None]
