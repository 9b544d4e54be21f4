"""Intervals, parsing and skewed keys against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.operators.intervals import interval_gaps, merge_intervals
from assaylake.operators.keyed import aggregate_by_key, keys_with_share
from assaylake.operators.parsing import failed_rows, valid_rows
from assaylake.plans.joins import semi_join_skewed

SCHEMA = "k string, start long, end long, chr string"


def brute(rows):
    by, stretches, gaps = {}, [], []
    for k, s, e, _ in rows:
        if s is not None and e is not None and s < e:
            by.setdefault(k, []).append((s, e))
    for k, xs in by.items():
        xs.sort()
        s, e, n = *xs[0], 1
        for a, b in xs[1:]:
            if a > e:
                stretches.append((k, s, e, n))
                gaps.append((k, e, a))
                s, e, n = a, b, 1
            else:
                e, n = max(e, b), n + 1
        stretches.append((k, s, e, n))
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted(stretches, key=key), sorted(gaps, key=key)


def key(r):
    return tuple((x is not None, x) for x in r)


@pytest.mark.parametrize("seed", range(3))
def test_intervals(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(400):
        s = rng.choice([rng.randrange(-20, 400), rng.randrange(0, 40)])
        rows.append((rng.choice(["a", "a", "a", "b", None]), s, s + rng.choice([-1, 0, 1, 2, 5, 60]), "x"))
    rows += [("c", None, 4, "x"), ("c", 4, None, None), ("d", 5, 9, "x"), ("d", 5, 9, "x"), ("e", 0, 10, "x"), ("e", 10, 20, "x"), ("e", 21, 22, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    stretches, gaps = brute(rows)
    assert sorted(map(tuple, interval_gaps(df, ["k"], tile=16).collect()), key=key) == gaps
    assert sorted(map(tuple, merge_intervals(df, ["k"], tile=16).collect()), key=key) == stretches


def test_intervals_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert interval_gaps(df, ["k"]).count() == 0 and merge_intervals(df, ["k"]).count() == 0


def test_clashing_columns(spark):
    rows = spark.createDataFrame([("a", 1, 2, 7, 7), ("a", 5, 6, 7, 7)], "k string, start long, end long, s long, carry long")
    assert [tuple(r) for r in interval_gaps(rows, ["k"]).collect()] == [("a", 2, 5)]


def test_semi_join_skewed(spark):
    df = spark.range(1000).select((F.col("id") % 3).cast("string").alias("bc"), "id")
    keys = spark.createDataFrame([("1",), ("1",), (None,)], "bc string")
    for limit in (10, 0):
        got = semi_join_skewed(df, keys, "bc", spread=F.col("id"), limit=limit)
        assert got.columns == ["bc", "id"] and sorted(r.id for r in got.collect()) == list(range(1, 1000, 3))


LINES = [
    (1, "chr1\t5\t9\tAC-1\t2", None), (2, "1\t5\tx\tAC-1\t2\r", None), (3, '"chr1"\t"5"\t9\t"AC"\t"02"', None),
    (4, "", "skip"), (5, None, "skip"), (6, "#x", "skip"), (7, "\r", "skip"), (8, " ", "column_count"),
    (9, 'chr1\t5"\t9', "quoting"), (10, 'chr1\t"\t9\ta\t1', "quoting"), (11, 'chr1\t""\t9\ta\t1', "start"), (12, '"a"b"\t1', "quoting"),
    (13, "chr1\t5\t9\ta\t1\t", "column_count"), (14, "chr9\t5\t9\ta\t1", "chr"), (15, "Chr1\tx\t9\ta\t1", "chr"), (16, "\t5\t9\ta\t1", "chr"),
    (17, "chr1\t100\t9\ta\t1", "start"), (18, "chr1\t99\t9\ta\t1", None), (19, "chr1\t٣\t9\ta\t1", "start"), (20, "chr1\t99999999999999999999999\t9\ta\t1", "start"),
    (21, "chr1\t00000000000000000000000000005\t9\ta\t1", None), (22, "chr1\t5\t9\ta\t00", "readSupport"), (23, "chr1\t5\t9\ta\t+1", "readSupport"),
    (24, "chr1\t5\t9\ta\t1\n", "readSupport"), (25, "chr1\t5\t9\ta\t1\r\r", "readSupport"), (26, "x" * 200_000, "column_count"), (None, "chr1\t5\t9\ta\t1", None),
    (1, "bad", "column_count"), (1, "bad", "column_count"), (None, "bad", "column_count"),
]


def test_parsing(spark):
    lines = spark.createDataFrame([(*r, "z") for r in LINES], "line_id long, line string, want string, chr string")
    genome = spark.createDataFrame([("chr1", 100), ("2", 50), (None, 1)], "chr string, length long")
    got = failed_rows(lines, genome)
    assert sorted(((r.line_id or 0, r.line, r.reason) for r in got.collect())) == sorted((i or 0, t, w) for i, t, w in LINES if w not in (None, "skip"))
    ok = valid_rows(lines, genome)
    assert sorted(r.line_id or 0 for r in ok.collect()) == sorted(i or 0 for i, _, w in LINES if w is None)
    by = {r.line_id: r for r in ok.collect()}
    assert tuple(by[3]) == (3, "chr1", 5, 9, "AC", 2) and by[2].end is None and by[21].start == 5
    assert failed_rows(lines.limit(0), genome).count() == 0


def test_keyed(spark):
    df = spark.createDataFrame([("a", 1), ("a", 5), (None, 2), ("b", None)], "k string, v long")
    got = aggregate_by_key(df, ["k"], [F.count(F.lit(1)).alias("n_rows"), F.max("v").alias("m")])
    assert {tuple(r) for r in got.collect()} == {("a", 2, 5), (None, 1, 2), ("b", 1, None)}
    assert [r.k for r in keys_with_share(got, df.agg(F.count(F.lit(1))), 0.5).collect()] == ["a"]
    assert keys_with_share(got.limit(0), df.limit(0).agg(F.count(F.lit(1))), 0.5).count() == 0
    with pytest.raises(ValueError):
        aggregate_by_key(df, ["k"], [F.collect_list("v")])


def test_only_algebraic_aggregates(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "k string, v int")
    out = {r.k: (r.n, r.s) for r in aggregate_by_key(df, ["k"], [F.count(F.lit(1)).alias("n"), F.sum(F.col("v") + 1).alias("s")]).collect()}
    assert out == {"a": (2, 5), None: (1, 4)}
    for bad in (F.collect_list("v"), F.count_distinct("v"), F.percentile("v", 0.5), F.median("v"), F.mode("v")):
        with pytest.raises(ValueError):
            aggregate_by_key(df, ["k"], [bad])


def test_merging_within_a_task(spark):
    """Batches of any content: null keys, repeats, intervals that touch, ends of any size."""
    rng = np.random.default_rng(0)
    rows = [("a" if i % 3 else None, "x" if i % 5 else None, int(s), int(s + rng.integers(1, 30))) for i, s in enumerate(rng.integers(0, 4000, 900))]
    rows += [("b", "x", 10, 20), ("b", "x", 20, 30), ("b", "x", 20, 30), ("b", "x", 31, 1 << 50), ("c", "x", 1, 1 << 51), ("c", "x", 5, 9)]
    df = spark.createDataFrame(rows, "k string, c string, start long, end long").repartition(3)
    want = {}
    for k, c in {r[:2] for r in rows}:
        for s, e in sorted(r[2:] for r in rows if r[:2] == (k, c)):
            parts = want.setdefault((k, c), [])
            if parts and s <= parts[-1][1]:
                parts[-1] = [parts[-1][0], max(e, parts[-1][1]), parts[-1][2] + 1]
            else:
                parts.append([s, e, 1])
    got = {}
    for r in merge_intervals(df, ["k", "c"], tile=512).orderBy("start").collect():
        got.setdefault((r.k, r.c), []).append([r.start, r.end, r.n_intervals])
    assert got == want
