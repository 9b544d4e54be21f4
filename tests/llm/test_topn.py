import random

from assaylake.llm.topn import top_n_per_group

SCHEMA = "g string, i string, s double, rank int, _g string"


def brute(rows, n):
    best = {}
    for g, i, s in rows:
        if g is not None and s is not None and s == s:
            best[g, i] = max(best.get((g, i), s), s)
    out = set()
    for group in {g for g, _ in best}:
        items = sorted(((i, s) for (g, i), s in best.items() if g == group), key=lambda x: (-x[1], x[0] is None, (x[0] or "").encode()))
        out |= {(group, i, s, k + 1) for k, (i, s) in enumerate(items[:n])}
    return out


def run(spark, rows, n, parts=5):
    df = spark.createDataFrame([(*r, 9, "x") for r in rows], SCHEMA).repartition(parts)
    return {tuple(r) for r in top_n_per_group(df, "g", "i", "s", n).collect()}


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "é", None, "b", f"g{rng.randrange(50)}"]), rng.choice([None, f"i{rng.randrange(300)}", "Z", "z", "é"]), rng.choice([1.0, 2.0, float("nan"), None, rng.random(), -0.0, 0.0, float("inf")])) for _ in range(6000)]
    assert run(spark, rows, 5) == brute(rows, 5)
    assert run(spark, rows, 1) == brute(rows, 1)


def test_edges(spark):
    assert run(spark, [], 5) == set()
    assert run(spark, [("a", "x", 1.0)] * 50, 5) == {("a", "x", 1.0, 1)}
    one = [("hot", f"i{k:06d}", float(k % 7)) for k in range(30_000)]  # one group of many Arrow batches
    assert run(spark, one, 3, parts=1) == brute(one, 3)
