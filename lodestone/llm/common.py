"""What the training-data operators share: tables, durable cuts of the lineage, slices of Arrow batches, distributed prefix sums."""

import re
import sys
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of text that a numpy kernel takes at once; it needs some 60 times as much memory.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ships(module: str) -> None:
    """Tasks get the functions of this module with the job, so that executors needn't have the package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ships(__name__)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir, or a new local one where none is set and all runs locally."""
    sc = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) is None and sc.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
    return sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")


def durable(df: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """df, written once to the shared folder and read from there: lost executors don't take it with them.

    Results are read from these tables lazily, so they stay until the session's owner clears the folder, as checkpoints do.
    options: of the writer.
    """
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """What runs in here has the setting; it is put back after."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def narrow(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 in as few bytes each as the largest takes; wide() reads them."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def wide(buffer, n: int) -> np.ndarray:
    """The n numbers of a buffer that narrow() made."""
    return np.frombuffer(buffer, f"u{len(buffer) // n}") if n else np.empty(0, np.uint8)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_hash(c: str = "text") -> Column:
    """Tells apart rows that repeat a doc_id."""
    return F.xxhash64(F.coalesce(F.col(c), F.lit("")), F.col(c).isNull())


def free_name(name: str, docs: DataFrame) -> str:
    """The name, with underscores before it until docs has no such column."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = "_" + name
    return name


def same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of the keys of two frames."""
    on = F.lit(True)
    for k in keys:
        on = on & a[k].eqNullSafe(b[k])
    return on


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES):
    """Yields (first row, bytes, offsets) for runs of rows with about `most` bytes of text; nulls are empty texts. A row is never cut."""
    col = batch.column(column).cast(pa.large_string()).fill_null("")
    n = len(col)
    if not n:
        return
    _, at, data = col.buffers()
    offs = np.frombuffer(at, np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + most, "right")) - 1)
        last = min(last, n)
        yield first, data[offs[first] : offs[last]], offs[first : last + 1] - offs[first]
        first = last


def dealt(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """df, range-sorted by group and order and written once, with `_at`, the number of the partition: a large group lies in many."""
    return durable(df.repartitionByRange(*group, *order).withColumn("_at", F.spark_partition_id()))


def running(rows: DataFrame, group: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """Adds to dealt() rows, for each name, the sum of its value over the rows before this one in its group, by `order`.

    A window adds up within each partition's part of a group; the totals of the parts (partitions plus groups, not rows) are carried to those behind.
    """
    part = Window.partitionBy("_at", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*group).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    totals = rows.groupBy("_at", *group).agg(*[F.sum(v).alias(f"_sum_{k}") for k, v in values.items()])
    totals = totals.select(F.col("_at").alias("_at2"), *[F.col(g).alias(f"_g_{g}") for g in group], *[so_far(f"_sum_{k}", before).alias(f"_b_{k}") for k in values])
    out = rows.withColumns({f"_own_{k}": so_far(v, part) for k, v in values.items()})
    on = out["_at"] == totals["_at2"]
    for g in group:
        on = on & out[g].eqNullSafe(totals[f"_g_{g}"])
    return out.join(totals, on).select(*rows.columns, *[(F.col(f"_own_{k}") + F.col(f"_b_{k}")).alias(k) for k in values])
