import math
from collections import defaultdict

import pytest

from assaylake.llm.mixing import mix_sources

SIZES = "doc_id long, source string, n_tokens long, weight double, budget int"
TARGETS = "source string, target_share double, max_repeats int"


def data(spark, extra=()):
    rows = [(k, ["Big", " big ", "BIG"][k % 3], 50 + k % 101, 0.1 + (k % 10) / 10, 0) for k in range(3000)]
    rows += [(10_000 + k, "small", 40, 1.0, 0) for k in range(50)] + [(20_000 + k, "other", 100, 1.0, 0) for k in range(100)] + [(30_000, None, 77, 1.0, 0)] + list(extra)
    return rows, spark.createDataFrame(rows, SIZES)


def test_budgets(spark):
    rows, sizes = data(spark)
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.03, 4), ("small ", 0.01, 2), ("missing", 0.2, 3), ("none", None, None), (None, 0.1, 1)], TARGETS)
    m = mix_sources(sizes, targets, "doc_id", slices=16)
    total = sum(r[2] for r in rows)
    shares = {r.source: r for r in m.shares.collect()}
    assert set(shares) == {"big", "small", "missing", "none"}
    docs = m.documents.collect()
    got, size = defaultdict(int), {r[0]: r[2] for r in rows}
    for r in docs:
        got[r.source] += r.copies * size[r.doc_id]
        assert r.n_tokens == size[r.doc_id] and 1 <= r.copies <= {"big": 1, "small": 4}[r.source]
    assert len({r.doc_id for r in docs}) == len(docs)
    assert abs(got["big"] - 0.5 * total) <= 151 / 2 + 1
    assert got["small"] == 4 * 50 * 40 and not shares["small"].can_be_met  # the target needs more repeats than allowed
    assert shares["big"].can_be_met and shares["missing"].mixed_tokens == 0 and not shares["missing"].can_be_met
    assert math.isclose(sum(r.actual_share for r in shares.values()), 1.0)
    assert all(math.isclose(r.share_of_all, r.mixed_tokens / total) for r in shares.values()) and abs(shares["big"].share_of_all - 0.5) < 0.001
    assert {s: r.mixed_tokens for s, r in shares.items() if r.mixed_tokens} == dict(got)


def test_epochs_before_fraction(spark):
    _, sizes = data(spark)
    total = sizes.agg({"n_tokens": "sum"}).first()[0]
    targets = spark.createDataFrame([("small", 2.5 * 2000 / total, 5)], TARGETS)
    copies = [r.copies for r in mix_sources(sizes, targets, "doc_id", slices=4).documents.collect()]
    assert len(copies) == 50 and sorted(set(copies)) == [2, 3] and copies.count(3) == 25


def test_same_choice_at_any_partitioning(spark):
    _, sizes = data(spark)
    targets = spark.createDataFrame([("big", 0.3, 1)], TARGETS)
    a = {r.doc_id for r in mix_sources(sizes, targets, "doc_id", slices=3).documents.collect()}
    b = {r.doc_id for r in mix_sources(sizes.repartition(9), targets, "doc_id", slices=64).documents.collect()}
    assert a == b


def test_weights_matter(spark):
    rows = [(k, "s", 10, 1.0 if k % 2 else 0.1, 0) for k in range(4000)]
    sizes = spark.createDataFrame(rows, SIZES)
    chosen = [r.doc_id for r in mix_sources(sizes, spark.createDataFrame([("s", 0.2, 1)], TARGETS), "doc_id").documents.collect()]
    heavy = sum(k % 2 for k in chosen) / len(chosen)
    assert len(chosen) == 800 and 0.8 < heavy < 0.97


@pytest.mark.parametrize("case", ["no documents", "no targets", "zero sizes"])
def test_edges(spark, case):
    rows = [] if case == "no documents" else [(1, "a", 0 if case == "zero sizes" else 5, None, 0), (1, "a", None, float("nan"), 0)]
    targets = [] if case == "no targets" else [("a", 1.0, 2)]
    m = mix_sources(spark.createDataFrame(rows, SIZES), spark.createDataFrame(targets, TARGETS), "doc_id")
    assert m.shares.count() == len(targets)
    m.documents.collect()
