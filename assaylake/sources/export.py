"""Writing layers and features, and reading them again."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A layer is written as one compressed NumPy archive only up to so many non-zeros.
NPZ_VALUES = 50_000_000


def save_sparse(coo: DataFrame, path: str) -> None:
    coo.write.mode("overwrite").parquet(path)


def load_sparse(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_npz(coo: DataFrame, path: str, shape: tuple[int, int], *, row: str = "row", col: str = "col", limit: int = NPZ_VALUES) -> None:
    """A CSR archive (data, indices, indptr, shape) of a layer with integer codes; refuses larger ones."""
    if coo.count() > limit:
        raise ValueError(f"more than {limit} values; use save_sparse")
    t = coo.select(row, col, "value").orderBy(row, col).toPandas()
    indptr = np.concatenate([[0], np.cumsum(np.bincount(t[row], minlength=shape[0]))])
    np.savez_compressed(path, data=t["value"].to_numpy(), indices=t[col].to_numpy(), indptr=indptr, shape=np.array(shape))


def load_npz(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[int, int]]:
    """(row, col, value) and the shape of a CSR archive."""
    with np.load(path) as z:
        data, indices, indptr, shape = z["data"], z["indices"], z["indptr"], tuple(int(n) for n in z["shape"])
    import pandas as pd

    rows = np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))
    return spark.createDataFrame(pd.DataFrame({"row": rows.astype("int64"), "col": indices.astype("int64"), "value": data.astype(float)})), shape


def feature_bed(features: DataFrame, var_id: str = "var_id") -> DataFrame:
    """12 BED columns of features named ``chr:start-end``; what a name doesn't tell is a dot."""
    part = lambda i: F.regexp_extract(var_id, r"^(.*):(\d+)-(\d+)$", i)
    dots = [F.lit(".").alias(f"c{i}") for i in range(4, 13)]
    return features.where(F.col(var_id).rlike(r"^.*:\d+-\d+$")).select(part(1).alias("c1"), part(2).cast("long").alias("c2"), part(3).cast("long").alias("c3"), *dots)


def write_bed(features: DataFrame, path: str, var_id: str = "var_id") -> None:
    feature_bed(features, var_id).write.mode("overwrite").option("sep", "\t").csv(path)
