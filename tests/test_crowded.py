"""Few communities that hold all cells: their cells are joined with what is in the result, over many tasks."""

import pytest
from pyspark.sql import functions as F

from assaylake.operators import summaries as S
from assaylake.plans import joins as J


@pytest.fixture
def shuffled(spark):
    """The number of rows shuffled by the stages since the last call."""
    sc = spark.sparkContext

    def rows():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        new = [s for s in (stages.apply(i) for i in range(stages.size())) if s.stageId() > rows.seen]
        rows.seen = max([rows.seen, *(s.stageId() for s in new)])
        return sum(s.shuffleWriteRecords() for s in new)

    rows.seen = -1
    rows()
    return rows


def one_each(spark, n):
    """n cells of one community, each with a feature of its own active, and one feature active in all."""
    cells = spark.range(n).select(F.col("id").cast("string").alias("obs_id"))
    active = cells.select("obs_id", F.concat(F.lit("v"), "obs_id").alias("var_id")).union(cells.select("obs_id", F.lit("all")))
    return cells.select("obs_id", F.lit("c").alias("community")), active


def test_denoise_forms_no_pairs_below_the_threshold(spark, shuffled):
    communities, active = one_each(spark, 600)
    out = S.denoise(active, communities, 0.5).collect()
    assert sorted((r.obs_id, r.var_id) for r in out) == sorted((str(i), "all") for i in range(600))
    assert shuffled() < 600 * 600 / 10


def test_denoise_of_odd_rows(spark):
    communities = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", None), (None, "y"), ("e", "y"), ("e", "y")], "obs_id string, community string")
    active = spark.createDataFrame([("a", "p"), ("b", "p"), ("a", None), ("c", "p"), ("d", "p"), (None, "p"), ("e", "q")], "obs_id string, var_id string")
    # y holds four rows: p is active in one of them, q in two
    out = sorted(S.denoise(active, communities, 0.4).collect(), key=str)
    assert [tuple(r) for r in out] == sorted([("a", "p"), ("b", "p"), ("a", None), ("b", None), ("c", "q"), ("e", "q"), ("e", "q"), (None, "q")], key=lambda r: f"Row(obs_id={r[0]!r}, var_id={r[1]!r})")
    assert not S.denoise(active, communities, 1.0).count()


def test_activities_of_cells_in_the_same_communities_are_summed_once(spark, shuffled):
    communities, active = one_each(spark, 600)
    memberships = communities.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("sample"), "obs_id", "community")
    out = S.neighbourhood_activity(active, memberships).collect()
    assert len({(r.obs_id, r.var_id) for r in out}) == len(out) == 600 * 601
    assert {(r.var_id == "all", round(r.value, 6)) for r in out} == {(True, 2.0), (False, 0.003333)}
    assert shuffled() < 600 * 600 / 10


def test_activities_of_odd_rows(spark):
    rows = [(0, "a", "x"), (0, "b", "x"), (0, "c", "y"), (1, "a", "y"), (1, "b", "z"), (1, "b", "z"), (0, "d", None), (1, "d", "z"), (0, None, "y"), (0, None, "x"), (None, "a", "x"), (2, "e", "w")]
    live = [("a", "p"), ("b", "p"), ("c", "p"), ("c", "q"), ("b", None), ("d", "p"), (None, "p"), ("f", "p")]
    memberships = spark.createDataFrame(rows, "sample int, obs_id string, community string")
    active = spark.createDataFrame(live, "obs_id string, var_id string")
    want = {}
    for s, o, c in rows:
        if s is not None and c is not None:
            members = [x for t, x, d in rows if (t, d) == (s, c)]
            for x in members:
                for y, v in live:
                    if x is not None and x == y:
                        want[o, v] = want.get((o, v), 0) + 1 / len(members)
    got = [((r.obs_id, r.var_id), r.value) for r in S.neighbourhood_activity(active, memberships).collect()]
    assert len(got) == len(want) and dict(got) == pytest.approx(want)


@pytest.mark.parametrize("broadcast", [J.BROADCAST_KEYS, 0])
def test_crowded_join_is_the_plain_join(spark, monkeypatch, broadcast):
    monkeypatch.setattr(J, "BROADCAST_KEYS", broadcast)
    a = spark.range(400).select(F.when(F.col("id") % 9 > 0, F.floor(F.sqrt("id"))).alias("k"), F.lit("s").alias("s"), (F.col("id") % 100).alias("x"))
    b = spark.range(300).select(F.when(F.col("id") % 7 > 0, F.floor(F.sqrt("id"))).alias("k"), F.lit("s").alias("s"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("y"), F.lit(1.5).alias("z"))
    got, want = J.join_crowded(a, b, ["k", "s"], block=8), a.join(b, ["k", "s"]).select("k", "s", "x", "y", "z")
    assert got.columns == ["k", "s", "x", "y", "z"] and want.count()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_crowded_join_has_tasks_for_its_pairs(spark, monkeypatch):
    monkeypatch.setattr(J, "TASK_PAIRS", 10_000)
    n = 400
    one = spark.range(n).select(F.lit("c").alias("k"), "id")
    out = J.join_crowded(one, one.withColumnRenamed("id", "other"), ["k"], block=50).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert sum(r["count"] for r in out) == n * n
    assert len(out) > 8 and max(r["count"] for r in out) < n * n / 4
