"""Interval joins against all pairs: lengths of many levels, hot bins, gaps, containment; the rows dealt don't depend on lengths."""

import numpy as np
import pytest

from rangeflow.plans import intervals

SCHEMA = "id int, chrom string, start bigint, end bigint, strand string"


def ranges(seed: int, n: int, longest: int, span: int = 3_000_000) -> list[tuple]:
    rng = np.random.default_rng(seed)
    start = rng.integers(1, span, n)
    length = np.exp(rng.uniform(0, np.log(longest), n)).astype(int)
    return [(i, f"c{rng.integers(2)}", int(s), int(s + k - 1), str(rng.choice(["+", "-", "*"]))) for i, (s, k) in enumerate(zip(start, length, strict=True))]


def plain(left, right, gap=0, within=False, min_overlap=1, stranded=False) -> list[tuple]:
    out = []
    for i, c, s, e, st in left:
        for j, d, a, b, rt in right:
            ok = c == d and s <= b + gap and e >= a - gap and (not within or a <= s and e <= b)
            ok = ok and (min_overlap <= 1 or min(e, b) - max(s, a) + 1 >= min_overlap)
            if ok and (not stranded or st == rt or "*" in (st, rt)):
                out.append((i, j))
    return sorted(out)


LONGEST = [(30, 30), (50, 2_000_000), (2_000_000, 50), (900_000, 900_000)]
HOW = [{"gap": 700}, {"within": True}, {"min_overlap": 40}, {"stranded": True}]
CASES = [(x, {}, salted) for x in LONGEST for salted in (False, True)] + [(LONGEST[k], how, k % 2 == 0) for k, how in enumerate(HOW)] + [(LONGEST[3], how, False) for how in HOW[:3]]


@pytest.mark.parametrize("longest,how,salted", CASES)
def test_pairs(spark, monkeypatch, longest, how, salted):
    if salted:
        monkeypatch.setattr(intervals, "SALT_ROWS", 10)
        monkeypatch.setattr(intervals, "HOT_ROWS", 7)
    a, b = ranges(1, 150, longest[0]), ranges(2, 120, longest[1])
    found = intervals.interval_join(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), **how)
    assert found.columns == ["id", "chrom", "start", "end", "strand", "r_id", "r_chrom", "r_start", "r_end", "r_strand"]
    assert sorted((r["id"], r["r_id"]) for r in found.collect()) == plain(a, b, **how)


@pytest.mark.parametrize("how", ["left_semi", "left_anti"])
def test_inside_or_not(spark, how):
    a, b = ranges(3, 300, 2000, 300_000), ranges(4, 60, 100_000, 300_000)
    inside = {i for i, _ in plain(a, b, within=True)}
    found = intervals.interval_join(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), within=True, how=how)
    assert sorted(r["id"] for r in found.collect()) == sorted(r[0] for r in a if (r[0] in inside) == (how == "left_semi"))


def test_repeated_rows_and_one_hot_place(spark, monkeypatch):
    monkeypatch.setattr(intervals, "SALT_ROWS", 10)
    monkeypatch.setattr(intervals, "HOT_ROWS", 16)
    a, b = [(1, "c0", 500, 520, "*")] * 100, [(2, "c0", 510, 600, "*")] * 50
    assert intervals.interval_join(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)).count() == 5000


def test_rows_dealt_do_not_depend_on_length(spark):
    long = spark.createDataFrame([(i, "c0", 1 + i, 200_000_000 + i, "*") for i in range(20)], SCHEMA)
    short = spark.createDataFrame([(i, "c0", 100_000_000 * i, 100_000_000 * i + 9, "*") for i in range(10)], SCHEMA)
    level = intervals._level
    dealt = intervals._dealt(long, "l", long["start"], long["end"], [(9, level(long["start"], long["end"], 1000) >= 0, 1000 * 4**9)])
    assert dealt.count() <= 2 * 20
    assert intervals.interval_join(long, short).count() == len(plain(long.collect(), short.collect()))


def test_empty_sides(spark):
    some, none = spark.createDataFrame(ranges(5, 9, 50), SCHEMA), spark.createDataFrame([], SCHEMA)
    for a, b in ((some, none), (none, some), (none, none)):
        assert intervals.interval_join(a, b).count() == 0
    assert intervals.interval_join(some, none, within=True, how="left_anti").count() == 9
    assert intervals.interval_join(some, none, within=True, how="left_semi").count() == 0
