"""Tilted windows: the arithmetic against carrying, and the worked example."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tiltmine.functions import tilted
from tiltmine.operators import windows

VALUES = [45, 67, 88, 93, 34, 49, 36, 97, *[50] * 4, *[25] * 84, 10, 10, 10, 10, 20, 20, 20, 20, 30]


def carried(n):
    """Batches by bucket, by pushing full levels on when the next value comes."""
    levels = [[] for _ in tilted.SIZES]

    def push(level, value):
        if level == len(levels):
            return
        if len(levels[level]) == tilted.SIZES[level]:
            push(level + 1, [b for v in levels[level] for b in v])
            levels[level].clear()
        levels[level].append(value)

    for j in range(n):
        push(0, [j])
    return {j: tilted.OFFSETS[i] + k for i, level in enumerate(levels) for k, v in enumerate(reversed(level)) for j in v}


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 9000))
def test_arithmetic_is_carrying(n):
    want = carried(n)
    for j in range(0, n, max(1, n // 200)):
        assert tilted.bucket_of(n, j) == want.get(j)


def test_year_drops_the_oldest():
    n = 80_000
    want = carried(n)
    for j in range(0, n, 997):
        assert tilted.bucket_of(n, j) == want.get(j)


@pytest.mark.parametrize("n", [0, 1, 5, 97, 3077, 40_000, 75_000])
def test_expression_is_the_function(spark, n):
    rows = spark.range(0, n + 2, max(1, n // 300)).select("id", tilted.bucket(n, F.col("id")).alias("b")).collect()
    assert all(r.b == tilted.bucket_of(n, r.id) for r in rows)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4000), st.integers(0, 71), st.integers(0, 71))
def test_batch_ranges(n, a, b):
    first, last = min(a, b), max(a, b)
    low, high = tilted.batch_range(n, first, last)
    assert {j for j in range(n) if (x := tilted.bucket_of(n, j)) is not None and first <= x <= last} == set(range(low, high + 1))


def window(spark, n):
    rows = spark.createDataFrame([("p", j, v) for j, v in enumerate(VALUES[:n])], "pattern string, batch_id int, support long")
    return rows, {r.bucket: r.support for r in tilted.windows(rows, n).collect()}


@pytest.mark.parametrize(
    ("n", "want"),
    [
        (4, {0: 93, 1: 88, 2: 67, 3: 45}),
        (8, {0: 97, 1: 36, 2: 49, 3: 34, 4: 293}),
        (12, {0: 50, 1: 50, 2: 50, 3: 50, 4: 216, 5: 293}),
        (96, {**dict.fromkeys(range(4), 25), **dict.fromkeys(range(4, 24), 100), 24: 200, 25: 216, 26: 293}),
        (97, {0: 10, **dict.fromkeys(range(4, 25), 100), 25: 200, 26: 216, 27: 293}),
    ],
)
def test_worked_example(spark, n, want):
    assert window(spark, n)[1] == want


def test_worked_example_after_a_day(spark):
    assert window(spark, 101)[1] == {0: 20, 4: 40, 28: 2809}


def test_drop_tail(spark):
    rows, _ = window(spark, 105)
    assert {r.bucket: r.support for r in tilted.windows(tilted.drop_tail(rows, 105, 1), 105).collect()} == {0: 30}
    assert tilted.drop_tail(rows, 105, 0).count() == 0


def test_dump_and_sums(spark):
    rows, found = window(spark, 8)
    assert tilted.dump(tilted.windows(rows, 8), 6).first().buckets == [97, 36, 49, 34, 293, None]
    assert tilted.range_sum(rows, 8, 1, 4).first().support == 36 + 49 + 34 + 293


def test_distances():
    assert [tilted.distance(b) for b in (0, 4, 28, 59, 71)] == [0, 4, 100, 3076, 38788] and tilted.distance(71, True) == 74500
    with pytest.raises(ValueError):
        tilted.distance(72)


def test_clock():
    c = tilted.clock(0, 899, *tilted.RANGES["quarter"])
    assert (c.start, c.end) == (0, 900)
    assert tilted.clock(5, 899, *tilted.RANGES["all"]).start == 5


@pytest.mark.parametrize(("size", "want"), [(2, None), (3, None), (20, None), (21, 4)])
def test_droppable_tail(spark, size, want):
    w = spark.createDataFrame([("p", 0, 0), ("p", 4, 1)], "pattern string, bucket int, support long")
    sizes = spark.createDataFrame([(4, size)], "bucket int, size long")
    assert windows.droppable_tails(w, sizes, 0.4, 0.05).first().drop_from == want


def test_batches_skip_empty_quarters(spark):
    rows = spark.createDataFrame([(10,), (10,), (12,), (40,), (None,)], "quarter long")
    assert {(r.quarter, r.batch_id) for r in windows.with_batches(rows).collect()} == {(10, 0), (12, 1), (40, 2)}
    assert {(r.quarter, r.batch_id) for r in windows.with_batches(rows.dropna(), calendar=True).collect()} == {(10, 0), (12, 2), (40, 30)}


def test_late_rows_join_the_open_quarter(spark):
    rows = spark.createDataFrame([(0, 5), (1, 7), (2, 6), (3, 7), (4, 9), (5, 1)], "line long, quarter long")
    assert [r.open_quarter for r in windows.open_quarter(rows, "line", chunk=2).orderBy("line").collect()] == [5, 7, 7, 7, 9, 9]


def test_union_of_ranges_counts_once(spark):
    sizes = spark.createDataFrame([(j, 10, 10) for j in range(8)], "batch_id int, events long, transactions long")
    assert windows.events_in(sizes, 8, 0, 3) == 40 and windows.events_in_union(sizes, 8, [(0, 3), (2, 4)]) == 80
