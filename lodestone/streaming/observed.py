"""Stateful streams: turns of a session observed as they come, term counts that expire, late rows and progress kept as tables.

States are kept by key in RocksDB (transformWithState); a session's earlier claims stand in a map state by term, so a new claim reads those that share
a term with it, not all.
"""

import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from lodestone.functions import text as T
from lodestone.streaming.jobs import bucket

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks get these functions with the job

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class rocks:
    """Sets the state store that transformWithState needs while a stream is started, and puts the session's own back."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self):
        self.before = self.spark.conf.get(PROVIDER, None)
        self.spark.conf.set(PROVIDER, STORE)

    def __exit__(self, *_):
        if self.before is None:
            self.spark.conf.unset(PROVIDER)
        else:
            self.spark.conf.set(PROVIDER, self.before)


# --- sessions

TURN = "session_id long, turn long, n_claims long, n_conflicts long, conflicts string, active string, total_claims long, total_conflicts long"
#: A claim contradicts an earlier one of opposite polarity that shares this part of the shorter one's terms; terms that a frame keeps.
OVERLAP, FRAME_TERMS = 0.45, 12


class Sessions(StatefulProcessor):
    """Folds a session's turns in their order: claims against earlier ones, the frame's active terms, running totals."""

    def __init__(self, most: int, idle_ms: int):
        self.most, self.idle = most, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "claims long, conflicts long, active string, timer long")
        self.held = handle.getMapState("held", "term string", "ids string")  # claims that hold a term, in their order
        self.claims = handle.getMapState("claims", "id long", "n int, negated boolean")

    def conflict(self, claim) -> int | None:
        """The first earlier claim that this one contradicts."""
        shared: dict[int, int] = {}
        for t in claim["terms"]:
            if self.held.containsKey((t,)):
                for i in self.held.getValue((t,))[0].split(","):
                    shared[int(i)] = shared.get(int(i), 0) + 1
        for i in sorted(shared):
            n, negated = self.claims.getValue((i,))
            if i < claim["claim_id"] and negated != claim["negated"] and shared[i] / max(1, min(n, len(claim["terms"]))) >= OVERLAP:
                return i
        return None

    def remember(self, claim) -> None:
        self.claims.updateValue((claim["claim_id"],), (len(claim["terms"]), claim["negated"]))
        for t in claim["terms"]:
            before = self.held.getValue((t,))[0] + "," if self.held.containsKey((t,)) else ""
            self.held.updateValue((t,), (f"{before}{claim['claim_id']}",))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, bad, active, timer = self.totals.get() if self.totals.exists() else (0, 0, "", 0)
        out = []
        frame = pd.concat(list(rows)).sort_values("turn")
        for r in frame.itertuples():
            hits = []
            for c in sorted(r.claims, key=lambda c: c["claim_id"]):
                prior = self.conflict(c)
                if prior is not None:
                    hits.append(f"{c['claim_id']}:{prior}")
                self.remember(c)
            terms = list(dict.fromkeys([*r.terms, *(active.split(" ") if active else [])]))[: self.most]
            active, n, bad = " ".join(terms), n + len(r.claims), bad + len(hits)
            out.append((key[0], r.turn, len(r.claims), len(hits), ",".join(hits), active, n, bad))
        due = int(frame["us"].max()) // 1000 + self.idle
        if due > timer:
            if timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        self.totals.update((n, bad, active, timer))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TURN.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.totals, self.held, self.claims):
            state.clear()
        yield pd.DataFrame(columns=[c.split()[0] for c in TURN.split(", ")])

    def close(self) -> None:
        pass


def turn_rows(turns: DataFrame, negators: list[str]) -> DataFrame:
    """(session_id, turn, ts, terms, claims) for observe_sessions: all that can be done without state. turns: (session_id, turn, ts, text, claims), the
    turn's claims as an array of (claim_id, claim), numbered in the order of the session."""
    made = F.transform("claims", lambda c: F.struct(c["claim_id"].cast("long").alias("claim_id"), T.important_terms(c["claim"], 24).alias("terms"), (T.hits(c["claim"], negators) > 0).alias("negated")))
    return turns.select(F.col("session_id").cast("long").alias("session_id"), F.col("turn").cast("long").alias("turn"), "ts", T.important_terms(F.col("text"), 6).alias("terms"), made.alias("claims"))


def observe_sessions(turns: DataFrame, most: int = FRAME_TERMS, delay: str = "1 hour", idle: int = 48 * 3600) -> DataFrame:
    """A row for each turn (TURN): its claims, those that contradict an earlier claim of the session (claim:earlier), the active terms after it, and
    running totals. Equal to claims.claim_conflicts and expansion.frames over all turns, so long as a session's turns come in their order.

    A session without a turn for `idle` seconds of event time is forgotten. A null session is one of its own.
    """
    return turns.withColumn("us", F.unix_micros("ts")).withWatermark("ts", delay).groupBy("session_id").transformWithStateInPandas(Sessions(most, idle * 1000), TURN, "Append", "EventTime")


# --- term counts

COUNTED = "scope long, term string, alpha double, beta double, updates long, last_us long"


class Counts(StatefulProcessor):
    """Beta counts of the terms of a bucket; a term's begin anew once `ttl` has passed without an update, and are forgotten with the watermark."""

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "held string, timer long")

    def keep(self, held: dict, timer: int, watermark: int) -> None:
        """Keeps what may still be added to, and a timer at which all of it is past its time."""
        held = {k: x for k, x in held.items() if x[3] // 1000 + self.ttl + 1 > watermark}
        due = max((x[3] // 1000 + self.ttl + 1 for x in held.values()), default=0)
        if timer and timer != due:
            self.handle.deleteTimer(timer)
        if not held:
            self.counts.clear()
            return
        if timer != due:
            self.handle.registerTimer(due)
        self.counts.update((json.dumps(held), due))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        text, timer = self.counts.get() if self.counts.exists() else ("{}", 0)
        held = json.loads(text)
        frame = pd.concat(list(rows)).dropna(subset=["utility"]).sort_values(["us", "event_id"])
        for k, ts, u in zip(frame["held_key"].tolist(), frame["us"].tolist(), frame["utility"].tolist(), strict=True):
            a, b, n, last = held.get(k, (1.0, 1.0, 0, None))
            if last is not None and ts > last + self.ttl * 1000:
                a, b, n = 1.0, 1.0, 0
            held[k] = (a + max(0.0, u), b + max(0.0, -u), n + 1, ts if last is None else max(last, ts))
        seen = frame["held_key"].unique().tolist()
        if not seen:
            return
        self.keep(held, timer, timerValues.getCurrentWatermarkInMs())
        scope, term = zip(*map(json.loads, seen), strict=True)
        a, b, n, last = zip(*(held[k] for k in seen), strict=True)
        yield pd.DataFrame({"scope": pd.array([None if x is None else int(x) for x in scope], "Int64"), "term": list(term), "alpha": list(a), "beta": list(b), "updates": list(n), "last_us": list(last)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.counts.clear()
        yield pd.DataFrame({"scope": pd.Series(dtype="int64"), "term": pd.Series(dtype=str), "alpha": pd.Series(dtype=float), "beta": pd.Series(dtype=float), "updates": pd.Series(dtype="int64"), "last_us": pd.Series(dtype="int64")})

    def close(self) -> None:
        pass


def expiring_counts(stream: DataFrame, ttl: int, delay: str) -> DataFrame:
    """(scope, term, alpha, beta, updates, last_us) after each micro-batch in which a term has updates; last_us is the newest one's time.
    stream: (scope, term, ts, event_id, utility).

    Positive utilities add to alpha, negative ones to beta; both start at 1, and again once more than `ttl` seconds of event time lie between a
    term's newest update and the next. Null utilities are passed over. Rows behind the watermark are dropped (late_rows keeps them)."""
    text = F.to_json(F.array(F.col("scope").cast("string"), "term"), {"ignoreNullFields": "false"})
    keyed = stream.select(text.alias("held_key"), "ts", F.unix_micros("ts").alias("us"), "event_id", "utility", bucket("scope", "term"))
    return keyed.withWatermark("ts", delay).groupBy("bucket").transformWithStateInPandas(Counts(ttl * 1000), COUNTED, "Update", "EventTime")


# --- late rows and progress

def late_rows(stream: DataFrame, ts: str, delay_seconds: int, out: str, columns: list[str]):
    """Starts a stream that writes to out/late the rows that a stateful stream over the same files drops as late, by batch.

    Spark drops what is not above the newest time, two batches back, less the delay. The newest time up to each batch is kept in out/marks by batch
    number: a batch that runs again writes the same.
    """

    def split(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        newest = df.agg(F.max(ts).alias("newest")).first()["newest"]
        marks = [(n, newest)]
        before = None
        if n:
            known = spark.read.schema("batch long, newest timestamp").parquet(f"{out}/marks").filter(F.col("batch") < n)
            before = known.filter(F.col("batch") <= n - 2).agg(F.max("newest").alias("m")).first()["m"]
        spark.createDataFrame(marks, "batch long, newest timestamp").coalesce(1).write.mode("overwrite").parquet(f"{out}/marks/part={n}")
        behind = F.lit(False) if before is None else F.unix_micros(F.col(ts)) <= (F.floor(F.unix_micros(F.lit(before)) / 1000) - delay_seconds * 1000) * 1000
        df.filter(behind).select(*columns).write.mode("overwrite").parquet(f"{out}/late/part={n}")

    return stream.writeStream.foreachBatch(split).option("checkpointLocation", f"{out}/late_checkpoint").trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """Keeps, for each micro-batch of every stream of the session, what went in and what was dropped; rows() gives them for a table."""

    def __init__(self):
        self.seen: list[tuple] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        states = p.stateOperators or []
        self.seen.append((str(p.runId), p.name, p.batchId, p.numInputRows, sum(s.numRowsDroppedByWatermark for s in states), sum(s.numRowsTotal for s in states), p.batchDuration))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.seen, "run_id string, name string, batch long, rows long, dropped long, state_rows long, ms long")


def run_stream(stream: DataFrame, out: str, mode: str, checkpoint: str, name: str | None = None) -> None:
    """Runs a stream over what is there; each micro-batch overwrites its own folder, so one that runs again changes nothing."""
    w = stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/part={n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    with rocks(stream.sparkSession):
        q = (w.queryName(name) if name else w).start()
    q.awaitTermination()
