import datetime
import random

import pytest

from facetcube.model import Cube, HexDimension, Member, ModelError, NumericMeasure, TimeHourHierarchy
from facetcube.plans.planner import Slice, find_cuboid, step, suitable, time_ranges

A_B = [("AB", True), ("BA", True), ("ACB", True), ("BAC", True), ("BCA", False), ("CAB", False), ("CBA", False)]
A_B_C = [("ACB", True), ("ABC", True), ("BAC", True), ("BADC", True), ("ADCB", True), ("BCA", False), ("CAB", False), ("CBA", False)]


def cube(*paths):
    return Cube.of("x", [HexDimension(d, 2) for d in "ABCD"], [list(p) for p in paths], [NumericMeasure("m")])


def point(d):
    return Slice(d, 1, False, 1, False)


@pytest.mark.parametrize(("path", "ok"), A_B)
def test_prefix_rule(path, ok):
    assert suitable(cube(path).cuboids[0], [point("B")], ["A"]) == ok


@pytest.mark.parametrize(("path", "ok"), A_B_C)
def test_prefix_rule_with_interval(path, ok):
    assert suitable(cube(path).cuboids[0], [point("B"), Slice("C", 1, False, 2, True)], ["A"]) == ok


def test_choice():
    c = cube("ABC", "CA", "AC", "A")
    assert find_cuboid(c, [], ["A"]).path == "A"
    assert find_cuboid(c, [], ["A", "C"]).path == "C/A"
    assert find_cuboid(c, [Slice("C", 1, False, 9, False)], ["A"], strict=True).path == "A/C"
    with pytest.raises(ModelError, match="suitable"):
        find_cuboid(c, [], ["D"])
    with pytest.raises(ModelError, match="suitable"):
        find_cuboid(cube("BA"), [], ["A"], strict=True)


def hours(ranges):
    """Hours that (level, least, largest) ranges cover between two fixed years."""
    h, out = TimeHourHierarchy("t"), []
    t = datetime.datetime(2023, 11, 1)
    while t < datetime.datetime(2024, 5, 1):
        for level, low, high in ranges:
            k = h.bound(t, level)
            if (low is None or k >= low) and (high is None or k <= high):
                out.append(t)
        t += datetime.timedelta(hours=1)
    return out


def test_ranges_cover_the_interval_exactly_once():
    rng, h = random.Random(7), TimeHourHierarchy("t")
    first = datetime.datetime(2023, 11, 1)
    edges = [datetime.datetime(2024, 1, 1), datetime.datetime(2024, 2, 1), datetime.datetime(2024, 1, 31, 23)]
    for _ in range(40):
        a, b = sorted(rng.choice([*edges, first + datetime.timedelta(minutes=rng.randrange(60 * 24 * 180))]) for _ in range(2))
        lo, ro = rng.random() < 0.5, rng.random() < 0.5
        left, right = (None if rng.random() < 0.1 else a), (None if rng.random() < 0.1 else b)
        got = hours(time_ranges(h, Slice("t", left, lo, right, ro)))
        cut = lambda x: x.replace(minute=0, second=0)
        expected = [t for t in hours([(2, None, None)]) if (left is None or (t > cut(a) if lo else t >= cut(a))) and (right is None or (t < cut(b) if ro else t <= cut(b)))]
        assert got and sorted(got) == expected or not expected and not got


def test_aligned_months_are_read_at_the_coarse_level():
    h = TimeHourHierarchy("t")
    assert time_ranges(h, Slice("t", "2024-01-01", False, "2024-03-01", True)) == [(1, "202401", "202402")]
    assert time_ranges(h, Slice("t", "2024-01-05", False, "2024-01-05", True)) == []
    assert len(time_ranges(h, Slice("t", "2024-01-05", False, "2024-04-05", True))) == 3
    assert time_ranges(h, Slice("t", Member("2024-01-05", 1), False, Member("2024-03-01", 1), False)) == [(1, "202401", "202403")]
    with pytest.raises(ModelError):
        time_ranges(h, Slice("t", Member("2024-01-05", 1), False, Member("2024-03-01", 2), False))
    assert step(h, "202412", 1, 1) == "202501" and step(h, "2024010100", 2, -1) == "2023123123"
