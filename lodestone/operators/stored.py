"""Tables that are updated: memory states by session, ideas as mergeable partial sums with deltas and snapshots, backfills that go on where they stopped."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators.windows import with_states
from lodestone.sources.store import durable, exists, numbers

# --- memory states (UPS-3)

PARTS = 64


def update_states(spark: SparkSession, path: str, rows: DataFrame, working: int, parts: int = PARTS) -> None:
    """Adds memory rows to the table at `path` and recomputes the states of the sessions that they touch; other sessions' rows stay as they are.

    Sessions lie in `parts` partitions by a hash of their id; only those with a touched session are written again (dynamic partition overwrite).
    rows: session_id, turn_index, role, importance and more; a row that is there already (session, turn, role) is replaced.
    """
    key = ["session_id", "turn_index", "role"]
    new = durable(rows.withColumn("part", F.pmod(F.xxhash64("session_id"), F.lit(parts)).cast("int")))
    touched = [r["part"] for r in new.select("part").distinct().collect()]  # `parts` numbers at most
    if not touched:
        return
    sessions = new.select("session_id").distinct()
    if exists(spark, path):
        old = spark.read.parquet(path).filter(F.col("part").isin(touched))
        rest = old.join(sessions, "session_id", "left_anti")
        mine = old.drop("memory_state").join(sessions, "session_id", "left_semi").join(new.select(*key), key, "left_anti").unionByName(new)
        out = with_states(mine, working).select(*rest.columns).unionByName(rest)
    else:
        out = with_states(new, working).select(*new.columns, "memory_state")
    durable(out).repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


# --- ideas (AGG-19, UPS-5)

# Ideas of a turn that one idea is linked with, and links that are kept; weights of an idea's importance.
TURN_LINKS, LINKS = 16, 48


def parent(idea: Column) -> Column:
    return F.when(F.contains(idea, F.lit(" ")), F.substring_index(idea, " ", 1))


class Ideas:
    """Ideas with frequency, reward, linked and child ideas, in a folder of numbered deltas and snapshots.

    A delta holds sums and first places by idea, which add up with any others: what is read is merged by grouping alone, in whatever order deltas
    came. A snapshot takes the place of all deltas up to its number. Each is written as a whole: a delta that is written again replaces itself.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    @staticmethod
    def parts(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(idea, session_id, n, reward, rewards, last_turn) and (idea, other, kind, first) of turns (session_id, turn_index, reward, ideas)."""
        t = turns.select("session_id", "turn_index", "reward", F.array_distinct("ideas").alias("ideas"))
        each = t.select("*", F.explode("ideas").alias("idea"))
        sums = each.groupBy("idea", "session_id").agg(F.count("*").alias("n"), F.sum("reward").alias("reward"), F.count("reward").alias("rewards"), F.max("turn_index").alias("last_turn"))
        others = F.filter("ideas", lambda x: x != F.col("idea"))
        lists = F.array(F.struct(F.lit("near").alias("kind"), F.slice(others, 1, TURN_LINKS).alias("l")), F.struct(F.lit("child").alias("kind"), F.slice(F.filter(others, lambda x: parent(x) == F.col("idea")), 1, TURN_LINKS).alias("l")))
        links = each.select("idea", "session_id", "turn_index", F.explode(lists).alias("k")).select("idea", "k.kind", "session_id", "turn_index", F.posexplode("k.l").alias("place", "other"))
        links = links.groupBy("idea", "other", "kind").agg(F.min(F.struct("turn_index", "session_id", "place")).alias("first"))
        return sums, links

    @staticmethod
    def added(sums: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
        s = sums.groupBy("idea", "session_id").agg(F.sum("n").alias("n"), F.sum("reward").alias("reward"), F.sum("rewards").alias("rewards"), F.max("last_turn").alias("last_turn"))
        return s, links.groupBy("idea", "other", "kind").agg(F.min("first").alias("first"))

    def add(self, turns: DataFrame, number: int) -> None:
        """Writes the delta of this number. Numbers rise; one at or below the last snapshot is in it already and is passed over."""
        if number <= max(numbers(self.spark, f"{self.root}/snapshots/links"), default=-1):
            return
        for name, df in zip(("sums", "links"), self.parts(turns), strict=True):
            df.write.mode("overwrite").parquet(f"{self.root}/deltas/{name}/number={number}")

    def tables(self, upto: int | None = None) -> tuple[DataFrame, DataFrame] | None:
        """The sums and links of the last snapshot and the deltas behind it, added up."""
        base = max(numbers(self.spark, f"{self.root}/snapshots/links"), default=-1)
        new = [i for i in numbers(self.spark, f"{self.root}/deltas/links") if i > base and (upto is None or i <= upto)]
        out = []
        for name in ("sums", "links"):
            paths = [f"{self.root}/snapshots/{name}/number={base}"] * (base >= 0) + [f"{self.root}/deltas/{name}/number={i}" for i in new]
            if not paths:
                return None
            out.append(self.spark.read.parquet(*paths))
        return self.added(*out)

    def compact(self, upto: int) -> None:
        """Writes the snapshot of this number from the deltas up to it; links go last, and make it valid."""
        for name, df in zip(("sums", "links"), self.tables(upto), strict=True):
            df.write.mode("overwrite").parquet(f"{self.root}/snapshots/{name}/number={upto}")

    def read(self) -> DataFrame:
        """(idea, frequency, sessions, reward_sum, reward_avg, cooccurring, children, importance); lists hold the first 48 by turn, session and place."""
        sums, links = self.tables()
        rank = F.row_number().over(Window.partitionBy("idea", "kind").orderBy("first", "other"))
        kept = links.withColumn("_r", rank).filter(F.col("_r") <= LINKS).groupBy("idea", "kind").agg(F.array_sort(F.collect_list(F.struct("_r", "other"))).alias("l"))
        lists = kept.groupBy("idea").agg(*[F.first(F.when(F.col("kind") == kind, F.col("l.other")), True).alias(name) for kind, name in (("near", "cooccurring"), ("child", "children"))])
        g = sums.groupBy("idea").agg(F.sum("n").alias("frequency"), F.count_distinct("session_id").alias("sessions"), F.round(F.sum("reward"), 6).alias("reward_sum"), F.round(F.sum("reward") / F.greatest(F.lit(1), F.sum("rewards")), 6).alias("reward_avg"))
        none = F.array().cast("array<string>")
        g = g.join(lists, "idea", "left").withColumns({c: F.coalesce(c, none) for c in ("cooccurring", "children")})
        score = 0.40 * F.log1p("frequency") / F.log(F.lit(33.0)) + 0.30 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("reward_avg", F.lit(0.0)))) + 0.20 + 0.10 * F.log1p(F.size("cooccurring") + F.size("children")) / F.log(F.lit(17.0))
        return g.withColumn("importance", F.round(F.least(F.lit(1.0), score), 4))


# --- backfill (STR-6)

def backfill_in_parts(rows: DataFrame, key: str, columns: list[str], score: Callable[[DataFrame], DataFrame], done: str, parts: int = 16, most: int | None = None) -> DataFrame:
    """rows with null `columns` filled by score(keys), which gives the columns for (key); each distinct key is scored once.

    The work is cut into parts by a hash of the key. A part's results are written to a table of its own under `done`; a run that finds it there doesn't
    score it again, so one that was stopped goes on where it was. Keys that come later are found by an anti-join with what is done. `most`: at
    most so many parts in this run.
    """
    spark = rows.sparkSession
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull()
    keys = rows.filter(missing & F.col(key).isNotNull()).select(key).distinct()
    before = numbers(spark, done)
    if before:
        keys = keys.join(spark.read.parquet(*[f"{done}/number={i}" for i in before]).select(key), key, "left_anti")
    keys = durable(keys.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts))))
    first = max(before, default=-1) + 1
    todo = sorted(r["_part"] for r in keys.select("_part").distinct().collect())  # `parts` numbers at most
    for i, part in enumerate(todo[:most]):
        score(keys.filter(F.col("_part") == part).select(key)).select(key, *columns).write.mode("overwrite").parquet(f"{done}/number={first + i}")
    have = numbers(spark, done)
    if not have:
        return rows
    s = spark.read.parquet(*[f"{done}/number={i}" for i in have]).select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
    filled = rows.filter(missing).join(s, F.col(key) == F.col("_k"), "left").select(*[F.coalesce(c, f"_{c}").alias(c) if c in columns else F.col(c) for c in rows.columns])
    return rows.filter(~missing).unionByName(filled)
