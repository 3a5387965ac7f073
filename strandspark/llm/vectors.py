"""Integer vectors and Arrow helpers that the vector operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Scaled components are cut to this magnitude, so that sums of squares stay in 64 bits.
LARGEST = 1 << 28


def integer_vectors(vectors: DataFrame, scale: int, vec_col: str, keep: dict[str, str], multiple: int = 1) -> tuple[DataFrame, int]:
    """(the columns ``keep`` under new names, x) of the rows that take part, and the length of x.

    ``x`` holds floor(scale * component), cut to ``LARGEST``. Rows take part whose
    vector is not null, holds no null or non-finite component, and has the length that
    most such vectors have (of equally frequent ones the smallest), which is over zero
    and divisible by ``multiple``. The length is 0 where there are none.
    """
    v = F.col(f"`{vec_col}`").cast("array<double>")
    own = vectors.select(*[F.col(f"`{c}`").alias(name) for name, c in keep.items()], v.alias("v")).where(F.coalesce((F.size("v") > 0) & (F.size("v") % multiple == 0), F.lit(False)))
    own = own.where(~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    most = own.groupBy(F.size("v").alias("length")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "length").first()
    length = most["length"] if most else 0
    cut = lambda c: F.greatest(F.least(F.floor(c * float(scale)).cast("long"), F.lit(LARGEST)), F.lit(-LARGEST))
    far = float(LARGEST) / scale
    x = F.transform("v", lambda c: cut(F.greatest(F.least(c, F.lit(far)), F.lit(-far))))
    return own.where(F.size("v") == length).select(*keep, x.alias("x")), length


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of equal lengths as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if len(column) else np.zeros((0, width), np.int64)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Rows of a matrix as a list column."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values).ravel(), kind))
