"""Mixing sources to target weights.

Targets come by reshared weights (water-filling); each source's documents are range-sorted by a hash-random key, distributed prefix
sums give every document's place among its source's words, and the mix takes whole epochs and then the words up to the exact budget.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import dealt, durable, running, ships, table

ships(__name__)

WEIGHTS, SHARE, MOST_EPOCHS = (5, 2, 1), 1.5, 2
TOKEN = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) with `target` (double): `share` of all sizes by weight, none above `most` times its size.

    Weights repeat along the sources by code point, null last. What a capped source leaves is reshared by weight until none is
    above; each round reads four sums, so the number of sources may be large.
    """
    # the place of a source in the order: counts of the range partitions before it, then within its own
    sorted_ = durable(sources.withColumn("_null", F.col("source").isNull()).repartitionByRange("_null", "source").withColumn("_at", F.spark_partition_id()))
    before = sorted_.groupBy("_at").agg(F.count("*").alias("_n")).select("_at", F.coalesce(F.sum("_n").over(Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_at").orderBy("_null", "source")) - 1 + F.col("_before")
    weighed = durable(sorted_.join(F.broadcast(before), "_at").withColumn("_p", F.pmod(place, F.lit(len(weights))).cast("int")).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("_p") + 1)).select("source", "source_size", "weight"))
    cap = F.col("source_size") * float(most)
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        full = cap <= level * F.col("weight") if capped >= 0 else F.lit(False)
        got = weighed.agg(F.count_if(full).alias("n"), F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("w")).first()
        if got["n"] == capped or not got["w"]:
            break
        capped, level = got["n"], (share * total - most * got["full"]) / got["w"]
    return weighed.withColumn("target", F.least(cap, F.col("weight") * level))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS, seed: str = "", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: id_col, source_col, size, source_size, target, taken, and the columns in keep.

    Size is the number of words (null: 0). A source's rows are taken in the order of md5(id, seed): floor(target / source_size)
    times whole, then up to the rest of the target, the last one in part. So each source's words meet floor(target) exactly and no
    document exceeds most times its size. Null sources are one source, the last. Rows that repeat an id follow each other in any order; as
    their sizes may differ, ties go by size. An empty table gives no rows.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(TOKEN)), F.lit(0)).cast("long").alias("size"), *keep)
    sized = durable(sized.withColumn("_key", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")))))
    goals = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    goals = goals.select(F.col("source").alias("_source"), "source_size", "target")
    order = ["_key", "doc_id", "size"]
    placed = running(dealt(sized, ["source"], order), ["source"], order, {"_before": F.col("size")})
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before")))
    return placed.join(goals, placed["source"].eqNullSafe(goals["_source"])).select(F.col("doc_id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", taken.cast("long").alias("taken"), *keep)


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':') AS k FROM documents),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM s),
-- water-filling: sources by the level at which they are full
r AS (SELECT *, sum(source_size) OVER o AS full_size, sum(weight) OVER o AS full_weight, row_number() OVER o AS n FROM w WINDOW o AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
t AS (SELECT sum(source_size) AS total, sum(weight) AS weights FROM w),
l AS (SELECT 0 AS n, 1.5 * total / weights AS level FROM t UNION ALL SELECT n, (1.5 * total - 2 * full_size) / (weights - full_weight) FROM r, t WHERE full_weight < weights),
g AS (SELECT level FROM l WHERE (SELECT count(*) FROM w WHERE 2.0 * source_size <= level * weight) = l.n ORDER BY n LIMIT 1),
q AS (SELECT source, source_size, least(2.0 * source_size, weight * level)::DOUBLE AS target FROM w, g),
p AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d),
x AS (SELECT p.*, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(floor(target) / source_size) AS BIGINT) ELSE 0 END AS e FROM p JOIN q ON p.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target,
       (e * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - e * source_size - before)))::BIGINT AS taken
FROM x
"""
