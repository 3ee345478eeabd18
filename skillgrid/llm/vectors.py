"""Vectors as rows of whole numbers, and sums over all of them: helpers of the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillgrid.llm.common import kept


def whole_numbers(vectors: DataFrame, vector: str, scale: float, limit: int, shift: int = 0, **columns: str) -> tuple[DataFrame, int]:
    """(table, width): a written table of ``x``, floor(scale * component) + shift of each vector, next to the given columns under new names.

    Rows whose vector is null or holds a null, NaN or infinite component are dropped. Components scaled beyond +-limit count as
    +-limit; limit + shift has to fit in 32 bits. Vectors shorter than the longest one are filled up with zeros.
    """
    finite = F.forall("_v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    top = F.lit(float(limit))
    numbers = F.transform("_v", lambda c: (F.floor(F.greatest(-top, F.least(top, c * F.lit(float(scale))))) + F.lit(shift)).cast("int"))
    rows = vectors.select(F.col(vector).cast("array<double>").alias("_v"), *[F.col(c).alias(new) for new, c in columns.items()])
    rows = rows.where(F.col("_v").isNotNull() & finite).select(*columns, numbers.alias("x"))
    rows = kept(rows, "vectors")
    width = rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    longest = width[1] or 0
    if width[0] != width[1]:
        rows = kept(rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(shift), F.lit(longest) - F.size("x")))), "vectors")
    return rows, longest


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an Arrow list column that all have ``width`` numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def summed(rows: DataFrame, height: int, width: int, part) -> np.ndarray:
    """The sum over all rows of a matrix of fixed size.

    ``part(batches)`` returns the matrix of a task as numpy array of whole or floating numbers. Tasks hand in one matrix each,
    Spark sums them by matrix row, and only the sum (height x width numbers) reaches the driver.
    """
    whole = getattr(part, "whole", False)
    kind, number = (np.int64, pa.int64()) if whole else (np.float64, pa.float64())

    def run(batches):
        got = part(batches)
        if got is None:
            return
        flat = pa.array(np.ascontiguousarray(got, kind).ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(height + 1, dtype=np.int32) * width), flat)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(height, dtype=np.int32)), lists.cast(pa.list_(number))], ["i", "v"])

    parts = rows.mapInArrow(run, f"i int, v array<{'long' if whole else 'double'}>")
    total = np.zeros((height, width), kind)
    for i, *values in parts.groupBy("i").agg(*[F.sum(F.col("v")[j]).alias(f"v{j}") for j in range(width)]).collect():
        total[i] = values
    return total
