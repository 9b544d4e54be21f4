"""Per-key results over keys of very uneven size."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Aggregates whose state has a fixed size and can be merged.
ALGEBRAIC = frozenset({"count", "count_if", "sum", "try_sum", "min", "max", "avg", "try_avg", "mean", "min_by", "max_by", "first", "last", "any_value", "bool_and", "bool_or", "every", "some", "bit_and", "bit_or", "bit_xor", "var_pop", "var_samp", "variance", "stddev", "stddev_pop", "stddev_samp", "std", "skewness", "kurtosis", "corr", "covar_pop", "covar_samp", "approx_count_distinct"})
#: Those whose state grows with the key, or is otherwise no fixed sum.
AGGREGATES = ALGEBRAIC | {"collect_list", "collect_set", "array_agg", "percentile", "percentile_cont", "percentile_disc", "median", "mode", "listagg", "string_agg", "histogram_numeric", "product"}


def aggregate_by_key(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Algebraic aggregates per key, without any task that sees all rows of a hot key.

    Every task folds its rows into a bounded hash table of mergeable states
    (count, sum, min, max, ...), which spills to a sorted run when it is full; only
    one compact state per task and key is shuffled. A key with a third of all rows
    therefore costs its final task no more than one row per map task. The
    aggregates must be algebraic: any other is refused, since its state may grow with
    the key.

    Null keys form a group; repeated rows count as often as they occur; an empty
    table gives no rows; other columns are ignored.
    """
    for a in aggs:
        # the analysed plan shows what a column's own text leaves out, such as DISTINCT
        line = df.groupBy(*keys).agg(a)._jdf.queryExecution().analyzed().toString().split("\n")[0].lower()
        used = set(re.findall(r"([a-z_0-9]+)\(", line)) & AGGREGATES
        if not used or used - ALGEBRAIC or "(distinct " in line:
            raise ValueError(f"{a} isn't known to be algebraic; only {sorted(ALGEBRAIC)} are")
    return df.groupBy(*keys).agg(*aggs)


def keys_with_share(counts: DataFrame, total: DataFrame, share: float, n: str = "n_rows") -> DataFrame:
    """Rows of ``counts`` whose ``n`` is at least ``share`` of the one value in ``total``.

    The total is read as a scalar subquery, not joined.
    """
    return counts.where((F.col(n) >= F.lit(share) * total.scalar()) & (F.col(n) > 0))
