"""Queries over whole tables against brute force."""

import pytest

from contactloom import registry
from contactloom.sources import tables as T

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def intervals(spark):
    return [tuple(r) for r in T.intervals(spark, SF).select("chrom", "start", "end", "id", "score").collect()]


def test_peak_filter_judges_all_intervals(spark, intervals):
    want = {}
    for c, s, e, i, _ in intervals:
        top = max((x for c2, s2, e2, _, x in intervals if c == c2 and s < e2 and s2 < e and x is not None), default=0)
        if top > 60:
            want[i] = top
    assert {r["id"]: r["score"] for r in registry.queries()["domain_peak_filter"](spark, SF).collect()} == want
    assert {i % 10 for i in want} == set(range(10))


def loops(intervals):
    return {i: (c, s, s + 1000, c, s + 20_000, s + 20_000 + 500 * (1 + i % 7)) for c, s, _, i, _ in intervals}


def test_merged_loops_of_all_intervals(spark, intervals):
    every = list(loops(intervals).values())
    once = [x for x in every if every.count(x) == 1]
    order = lambda x: (x[5] - x[4], -x[1], -x[4], -x[2])
    near = lambda x, y: x[0] == y[0] and x[1] - 2000 < y[2] and y[1] < x[2] + 2000 and x[4] - 2000 < y[5] and y[4] - 2000 < x[5]
    want = sorted(x for x in once if not any(near(x, y) and order(y) > order(x) for y in once))
    got = registry.queries()["merged_loops"](spark, SF).select("chrom1", "start1", "end1", "chrom2", "start2", "end2").collect()
    assert sorted(map(tuple, got)) == want and len(want) > len(intervals) // 7


def test_validated_loops_of_all_intervals(spark, intervals):
    peaks = [(c, s // 1000 * 1000, (e // 1000 + 1) * 1000) for c, s, e, _, x in intervals if x is not None and x > 70]
    hit = lambda c, s, e: any(c == p and a < e and s < b for p, a, b in peaks)
    want = {i for i, x in loops(intervals).items() if hit(*x[:3]) and hit(*x[3:])}
    assert {r["id"] for r in registry.queries()["validated_loops"](spark, SF).collect()} == want
    assert any(i % 7 for i in want)


def test_correction_runs_to_its_end(spark):
    from contactloom.operators import matrix as M

    px = T.pixels(spark, SF)
    bias = registry.queries()["ice_bias"](spark, SF)
    total = [r["total"] for r in M.marginals(M.apply_bias(px, bias)).where("total > 0").collect()]
    mean = sum(total) / len(total)
    assert max(abs(x / mean - 1) for x in total) < 1e-3  # biases come rounded to six digits
