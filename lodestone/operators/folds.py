"""Ordered folds over keys of any length: rows are range-sorted, tasks stream through them, and a key's state is handed on from partition to partition.

A fold whose steps don't combine (a value rounded at each step, a list with a cap) must see a key's rows one after another. Here no row or array holds
a whole key: a task keeps one state. All keys start at once; a key that reaches over k partitions takes k passes, each of which reads only the
partitions that such keys go on in. At most one key crosses a border between partitions, so handed-on states are no more than partitions.
"""

import pickle
import sys
from collections.abc import Callable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.store import durable, shared

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks get these functions with the job


def scanned(keys: list[str], start: Callable, step: Callable, each: bool, names: list[str], out: pa.Schema):
    """A mapInArrow function over rows sorted by key and order, with _from (the state handed on, or null): folds key by key. Gives for each row what
    step returns beside the state, if each, and for each key its state behind the last row."""

    def run(batches):
        key, state, made = None, None, {n: [] for n in names}

        def put(k, values, packed):
            for n, v in zip(names, [*k, *values, packed], strict=True):
                made[n].append(v)

        def flushed():
            batch = pa.RecordBatch.from_pydict({n: pa.array(made[n], out.field(n).type) for n in names}, schema=out)
            for n in names:
                made[n].clear()
            return batch

        width = len(names) - len(keys) - 1
        begun = False
        for b in batches:
            for row in b.to_pylist():
                k = tuple(row[c] for c in keys)
                if not begun or k != key:
                    if begun:
                        put(key, [None] * width, pickle.dumps(state))
                    key, begun = k, True
                    state = pickle.loads(row["_from"]) if row["_from"] is not None else start()
                state, values = step(state, row)
                if each:
                    put(key, values, None)
            if len(made[names[0]]) >= 4096:
                yield flushed()
        if begun:
            put(key, [None] * width, pickle.dumps(state))
        if made[names[0]]:
            yield flushed()

    return run


def fold(rows: DataFrame, keys: list[str], order: list[str], start: Callable, step: Callable, schema: str, each: bool = False, partitions: int | None = None) -> DataFrame:
    """keys and the columns of `schema`: for each row (each), or for each key behind its last row.

    start() gives a state; step(state, row as a dict) gives the next state and, for `each`, the values of `schema` in their order. Without `each` the
    state itself is a tuple of these values. Rows are taken by `order`, nulls first; rows that agree in it in any order. States are pickled where they are handed on, so they should stay small.
    """
    spark, root = rows.sparkSession, shared(rows.sparkSession)
    parts = (partitions, *keys, *order) if partitions else (*keys, *order)
    dealt = durable(rows.repartitionByRange(*parts).withColumn("_at", F.spark_partition_id()))
    spans = durable(dealt.groupBy(*keys).agg(F.min("_at").alias("_first"), F.max("_at").alias("_last")).filter("_last > _first").withColumnsRenamed({k: f"_k_{k}" for k in keys}))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    longest = spans.agg(F.max(F.col("_last") - F.col("_first"))).first()[0] or 0
    kinds = dict(rows.dtypes)
    full = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), schema, "_state binary"])
    fields = spark.createDataFrame([], full).schema.fields
    names, arrow = [f.name for f in fields], pa.schema([(f.name, to_arrow(f.dataType)) for f in fields])
    run = scanned(keys, start, step, each, names, arrow)
    passes = dealt.join(F.broadcast(spans), same, "left").withColumn("_pass", F.coalesce(F.col("_at") - F.col("_first"), F.lit(0))).select(*rows.columns, "_at", "_pass")  # no more rows than partitions
    state = None
    for n in range(longest + 1):
        now = passes.filter(F.col("_pass") == n)
        if state is None:
            now = now.withColumn("_from", F.lit(None).cast("binary"))
        else:
            now = now.join(F.broadcast(state), same, "left").select(*rows.columns, "_at", F.col("_state").alias("_from"))
        now = now.repartition("_at").sortWithinPartitions("_at", *keys, *order)
        now.mapInArrow(run, full).write.parquet(f"{root}/pass={n}")
        state = spark.read.schema(full).parquet(f"{root}/pass={n}").filter("_state IS NOT NULL").join(F.broadcast(spans), same).filter(F.col("_last") - F.col("_first") > n).select(*[f"_k_{k}" for k in keys], "_state")
    made = spark.read.schema(full + ", pass int").parquet(root)
    if each:
        return made.filter("_state IS NULL").drop("_state", "pass")
    last = made.filter("_state IS NOT NULL").join(F.broadcast(spans), same, "left").filter(F.col("pass") == F.coalesce(F.col("_last") - F.col("_first"), F.lit(0)))
    width = schema.split(", ")

    def opened(batches):
        for b in batches:
            states = [pickle.loads(x) for x in b.column("_state").to_pylist()]
            columns = list(zip(*states, strict=True)) if states else [[]] * len(width)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), *(pa.array(list(c), arrow.field(len(keys) + i).type) for i, c in enumerate(columns))], names=names[:-1])

    return last.select(*keys, "_state").mapInArrow(opened, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), schema]))


def to_arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
