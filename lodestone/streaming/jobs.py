"""Structured Streaming: turn observation, running values with state, expiring term counts, incremental ingest, backfill, windows."""

import json
import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks get these functions with the job

EVENTS = "event_id long, ts timestamp, scope long, state_key string, action int, reward double"


def read_events(spark: SparkSession, path: str, schema: str = EVENTS, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def observe(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs the batch operators on each micro-batch, once over what is there. `batch` must write by (batch id, key): batches may repeat."""
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Keys share their state by a hash: a call of Python a key and micro-batch would cost more than the rows do. Part of a stream's checkpoint.
BUCKETS = 1024


def bucket(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("bucket")


def running_values(stream: DataFrame, alpha: float = 0.25) -> DataFrame:
    """(scope, state_key, action, visits, q_value) after each micro-batch: a running estimate for each key, held in the state of its bucket.

    Within a micro-batch rewards are folded in the order of (ts, event_id); null rewards are passed over.
    """

    def fold(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for k, r in zip(rows["held_key"].tolist(), rows["reward"].tolist(), strict=True):
            visits, q = held.get(k, (0, 0.0))
            held[k] = (visits, q) if r is None or r != r else (visits + 1, round(q + alpha * (r - q), 6))
        state.update((json.dumps(held),))
        seen = rows["held_key"].unique().tolist()
        scope, state_key, action = zip(*map(json.loads, seen), strict=True)
        visits, q = zip(*(held[k] for k in seen), strict=True)
        yield pd.DataFrame({"scope": pd.array([None if x is None else int(x) for x in scope], "Int64"), "state_key": list(state_key), "action": pd.array([None if x is None else int(x) for x in action], "Int32"), "visits": list(visits), "q_value": list(q)})

    text = F.to_json(F.array(*[F.col(c).cast("string") for c in ("scope", "state_key", "action")]), {"ignoreNullFields": "false"})
    keyed = stream.select(text.alias("held_key"), "ts", "event_id", "reward", bucket("scope", "state_key", "action"))
    return keyed.groupBy("bucket").applyInPandasWithState(fold, "scope long, state_key string, action int, visits long, q_value double", "held string", "update", "NoTimeout")


def term_counts(stream: DataFrame, ttl_minutes: int = 120) -> DataFrame:
    """(scope, term, alpha, beta, updates): Beta counts of each term, dropped when the event time passes the last update by `ttl_minutes`.

    stream: (scope, term, ts, utility) with ts as timestamp; a watermark of the same length is set here.
    """

    def count(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        a, b, n = state.get if state.exists else (1.0, 1.0, 0)
        last = 0
        for f in frames:
            u = f["utility"].dropna()
            a, b, n = a + float(u[u > 0].sum()), b - float(u[u <= 0].sum()), n + len(u)
            last = max(last, int(f["ts"].max().timestamp() * 1000))
        state.update((a, b, n))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, last + ttl_minutes * 60_000))
        yield pd.DataFrame({"scope": [key[0]], "term": [key[1]], "alpha": [round(a, 6)], "beta": [round(b, 6)], "updates": [n]})

    return stream.withWatermark("ts", f"{ttl_minutes} minutes").groupBy("scope", "term").applyInPandasWithState(count, "scope long, term string, alpha double, beta double, updates long", "a double, b double, n long", "update", "EventTimeTimeout")


def ranked_terms(counts: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """(scope, rank, term, value): terms by a seeded draw from Beta(alpha, beta), or by its mean (seed None); two updates at least."""
    from lodestone.operators.retrieval import top

    rows = counts.filter("updates >= 2")
    if seed is None:
        rows = rows.withColumn("value", F.round(F.col("alpha") / (F.col("alpha") + F.col("beta")), 6))
    else:

        @F.pandas_udf("double")
        def draw(a: pd.Series, b: pd.Series, h: pd.Series) -> pd.Series:
            import numpy as np

            return pd.Series([np.random.default_rng([seed, int(k) & 0x7FFFFFFF]).beta(x, y) for x, y, k in zip(a, b, h, strict=True)])

        rows = rows.withColumn("value", F.round(draw("alpha", "beta", F.xxhash64("scope", "term")), 6))
    return top(rows, "scope", [F.desc("value"), "term"], n).select("scope", "rank", "term", "value")


def ingest_files(spark: SparkSession, path: str, out: str, rejected: str, checkpoint: str, policy: str = "permissive"):
    """Ingests new CSV files once; good rows and bad rows go to two tables, each batch to a folder of its own, so repeats replace it."""
    from lodestone.sources.files import COLUMNS, checked

    stream = spark.readStream.schema(", ".join(f"{c} string" for c in COLUMNS)).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)

    def write(df: DataFrame, batch: int) -> None:
        rows = checked(df, policy).persist()
        rows.filter("reject_reason IS NULL").write.mode("overwrite").parquet(f"{out}/batch={batch}")
        rows.filter("reject_reason IS NOT NULL").write.mode("overwrite").parquet(f"{rejected}/batch={batch}")
        rows.unpersist()

    return observe(stream, write, checkpoint)


def backfill(rows: DataFrame, scored: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with null label probabilities filled from `scored` (key and columns): scored once for each distinct key, restartable by an anti-join."""
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull()
    s = scored.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
    filled = rows.filter(missing).join(s, F.col(key) == F.col("_k"), "left").select(*[F.coalesce(c, f"_{c}").alias(c) if c in columns else F.col(c) for c in rows.columns])
    return rows.filter(~missing).unionByName(filled)


def session_activity(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(scope, start, end, n, mean_reward) of activity sessions; works on streams (with a watermark) and tables."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy("scope", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.avg("reward").alias("mean_reward"))
    return g.select("scope", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean_reward")


def windowed_means(events: DataFrame, length: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, state_key, n, mean_reward) in tumbling or sliding windows."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return e.groupBy(w.alias("w"), "state_key").agg(F.count("*").alias("n"), F.avg("reward").alias("mean_reward")).select(F.col("w.start").alias("start"), "state_key", "n", "mean_reward")
