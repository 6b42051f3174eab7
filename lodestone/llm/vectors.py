"""Embeddings as whole numbers: what the whitening and the mining of hard negatives share."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import ships

ships(__name__)

SCALE = 256


def dimension(df: DataFrame, vec_col: str) -> int:
    """The most frequent length of its vectors (ties: the largest); 0 where there are none."""
    row = df.filter(F.size(vec_col) > 0).groupBy(F.size(vec_col).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return row["d"] if row else 0


def whole_numbers(batch: pa.RecordBatch, vec_col: str, d: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(256 * c) of the vectors of length d without null, NaN or infinite entries, as float64, and which rows of the batch they are."""
    col = batch.column(vec_col)
    col = col.cast(pa.large_list(pa.float64())) if not pa.types.is_large_list(col.type) or col.type.value_type != pa.float64() else col
    n = len(col)
    offs = col.offsets.to_numpy()
    at = np.flatnonzero(np.asarray(col.is_valid()) & (np.diff(offs) == d)) if n else np.empty(0, np.int64)
    if not len(at) or not d:
        return np.empty((0, d)), np.empty(0, np.int64)
    flat = col.values.to_numpy(zero_copy_only=False)  # nulls as NaN
    x = flat[offs[at][:, None] + np.arange(d)]
    fine = np.isfinite(x).all(axis=1)
    return np.floor(SCALE * x[fine]) + 0.0, at[fine]
