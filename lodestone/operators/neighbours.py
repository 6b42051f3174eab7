"""Approximate nearest vectors: lists around coarse centroids, looked up by the nearest ones and re-ranked by the exact cosine.

Centroids are fitted on a bounded sample; every vector is put on the list of its nearest one, with its unit vector, in a table bucketed by list.
A list that grows beyond a bound is a hot key: it is cut into parts of bounded size, so no task takes a whole one. A query looks through its
nearest lists until they hold `candidates` vectors, so its work is bounded whatever the lists' sizes.
"""

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.sources.store import durable, shared

#: Rows that the centroids are fitted on, those of the smallest hash; rounds of fitting; vectors in a part of a list.
SAMPLE_ROWS, ROUNDS, PART_ROWS = 20_000, 8, 5_000


@dataclass(frozen=True)
class Lists:
    """centroids: unit rows; table: name of (list, part, doc, unit); sizes: (list, part, n)."""

    centroids: np.ndarray
    table: str
    sizes: DataFrame


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def centroids_of(sample: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """Spherical k-means on the sample; centroids without rows keep their place."""
    x = unit_rows(sample)
    c = x[np.random.default_rng(seed).permutation(len(x))[:n]]
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        some = np.linalg.norm(sums, axis=1) > 1e-12
        c = np.where(some[:, None], unit_rows(sums), c)
    return c


def stacked(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), float).reshape(len(column), -1)


def write_lists(vectors: DataFrame, lists: int | None = None, root: str | None = None) -> Lists:
    """Lists for (doc, vector); about the square root of the number of rows of them (at most 4096), if not told. Null vectors are left out."""
    spark = vectors.sparkSession
    rows = vectors.filter("vector IS NOT NULL").select("doc", F.col("vector").cast("array<double>").alias("vector"))
    sample = rows.orderBy(F.xxhash64("doc"), "doc").limit(SAMPLE_ROWS).collect()
    n = lists or min(4096, max(1, round(rows.count() ** 0.5)))
    c = centroids_of(np.array([r["vector"] for r in sample]).reshape(len(sample), -1), n) if sample else np.zeros((0, 0))

    def run(batches):
        for b in batches:
            x = unit_rows(stacked(b.column("vector"))) if b.num_rows else np.zeros((0, c.shape[1]))
            near = (x @ c.T).argmax(axis=1) if len(c) else np.zeros(len(x), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), b.column("doc"), pa.array(list(x), pa.list_(pa.float64()))], names=["list", "doc", "unit"])

    placed = durable(rows.mapInArrow(run, f"list int, doc {dict(rows.dtypes)['doc']}, unit array<double>"))
    parts = placed.groupBy("list").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
    placed = placed.join(parts, "list").withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int")).select("list", "part", "doc", "unit")
    buckets = max(1, min(n, 64))
    name = f"lodestone_{uuid.uuid4().hex}"
    placed.repartition(buckets, "list", "part").write.format("parquet").bucketBy(buckets, "list", "part").sortBy("list", "part").option("path", root or shared(spark)).saveAsTable(name)
    return Lists(c, name, durable(spark.table(name).groupBy("list", "part").agg(F.count("*").alias("n"))))


def looked_up(queries: DataFrame, lists: Lists, candidates: int) -> DataFrame:
    """(query_id, list, part, unit): the parts of its nearest lists that a query looks through: those that begin before `candidates` vectors."""
    c, kind = lists.centroids, dict(queries.dtypes)["query_id"]

    def run(batches):
        for b in batches:
            x = unit_rows(stacked(b.column("query_vector"))) if b.num_rows else np.zeros((0, c.shape[1]))
            order = np.argsort(-(x @ c.T), axis=1, kind="stable")
            n = order.shape[1]
            rep = pa.array(np.repeat(np.arange(len(x)), n))
            yield pa.RecordBatch.from_arrays([b.column("query_id").take(rep), pa.array(np.tile(np.arange(n, dtype=np.int32), len(x))), pa.array(order.ravel().astype(np.int32))], names=["query_id", "near", "list"])

    near = queries.select("query_id", F.col("query_vector").cast("array<double>").alias("query_vector")).mapInArrow(run, f"query_id {kind}, near int, list int")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("query_id").orderBy("near", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return near.join(lists.sizes, "list").withColumn("_before", before).filter(F.col("_before") < candidates).select("query_id", "list", "part")


def approximate(queries: DataFrame, lists: Lists, k: int, candidates: int = 1000) -> DataFrame:
    """(query_id, rank, doc, score) by cosine among some `candidates` vectors (query_id, query_vector); ties go to the smaller doc."""
    spark = queries.sparkSession
    own = queries.filter("query_vector IS NOT NULL").select("query_id", F.col("query_vector").cast("array<double>").alias("query_vector"))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    unit = own.select("query_id", F.transform("query_vector", lambda v: v / F.greatest(F.sqrt(total(F.transform("query_vector", lambda w: w * w))), F.lit(1e-12))).alias("q"))
    pairs = looked_up(own, lists, candidates).join(unit, "query_id").join(spark.table(lists.table), ["list", "part"])
    hits = pairs.select("query_id", "doc", F.round(total(F.zip_with("unit", "q", lambda a, b: a * b)), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc")).cast("long")
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "doc", "score")
