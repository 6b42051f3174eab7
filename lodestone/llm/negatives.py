"""Hard negatives by angular triangle filtering.

Every row is stored with its norm and its angles to a few reference directions. The angle between two vectors is at least the difference and
at most the sum of their angles to any reference (the triangle inequality on the sphere), so a block of rows whose angles lie in known intervals
has a cosine interval for each anchor, and norms make score bounds of it, widened by more than any rounding. Blocks hold 64 rows of
one label, close to one reference and ordered by that angle, so that the intervals are narrow. Only blocks whose bounds reach an anchor's
window (for positives: from its fifth best score so far; for negatives: the scores that a positive allows, from the third best so far) get
integer scores, as one matrix product for a span of blocks.

Anchors go to all tasks in batches of bounded size, one batch after another; a task reads shards of rows one by one and carries the thresholds
on. Two passes: positives first, merged exactly over all tasks, then the windows that they open.
"""

import copy
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import durable, shared_dir, ships, table
from lodestone.llm.vectors import dimension, whole_numbers

ships(__name__)

POSITIVES, NEGATIVES = 5, 3
#: A negative scores between these hundredths of the positive's score.
LOW, HIGH = 50, 95
ANCHOR_STEP, RELABEL_STEP, LABELS = 50, 7, 10
#: References are picked from at most so many rows (those of the smallest hash); any choice gives the same results.
REFERENCES, SAMPLE_ROWS = 16, 2048
SHARD_ROWS, BLOCK_ROWS, TASK_SHARDS, BATCH_BYTES = 16384, 64, 4, 8 << 20
#: Blocks that are looked at together, and anchors whose scores are laid out at once.
SPAN_BLOCKS, GROUP_ANCHORS = 32, 512
#: Radians and share of a score that bounds are widened by; rounding errors are some 1e-8 (arccos near 1) and 1e-15.
SLACK, WIDER = 1e-6, 1e-9

INDEX = "shard long, n_rows long, uids binary, ids binary, nulls binary, labels binary, x binary, norms binary, angles binary"
FOUND = "anchor long, window int, score long, id long, uid long"


def angles(x: np.ndarray, norms: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Of each row to each reference; a zero vector has a right angle to all (any will do: its scores are 0)."""
    return np.arccos(np.clip(x @ references.T / np.where(norms > 0, norms, 1)[:, None], -1, 1))


def references_of(sample: np.ndarray, most: int) -> np.ndarray:
    """Unit vectors far from each other: the sample's mean direction, then in turn the row with the largest angle to those picked."""
    norms = np.linalg.norm(sample, axis=1)
    unit = sample[norms > 0] / norms[norms > 0, None]
    if not len(unit):
        return np.zeros((0, sample.shape[1]))
    mean = unit.mean(axis=0)
    first = mean / np.linalg.norm(mean) if np.linalg.norm(mean) > 1e-6 else unit[0]
    picked, near = [first], unit @ first
    while len(picked) < most and near.min() < 1 - 1e-9:
        picked.append(unit[near.argmin()])
        near = np.maximum(near, unit @ picked[-1])
    return np.array(picked)


def index_shards(id_col: str, label_col: str, vec_col: str, d: int, references: np.ndarray, shard_rows: int):
    """A mapInArrow function: rows (id, label, vector) to shards, each ordered by label, nearest reference and angle to it."""

    def run(batches):
        from pyspark import TaskContext

        task, held, size, made = TaskContext.get().partitionId(), [], 0, 0

        def close():
            x, ids, nulls, labels = (np.concatenate(c) for c in zip(*held, strict=True))
            norms = np.linalg.norm(x, axis=1)
            theta = angles(x, norms, references)
            nearest = theta.argmin(axis=1) if len(references) else np.zeros(len(x), np.int64)
            by = np.lexsort((theta[np.arange(len(x)), nearest] if len(references) else norms, nearest, labels))
            shard = task * (1 << 16) + made
            cols = [shard * (1 << 20) + np.arange(len(x), dtype=np.int64), ids[by], nulls[by], labels[by], x[by], norms[by], theta[by]]
            return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([len(x)]), *(pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in cols)], names=[c.split()[0] for c in INDEX.split(", ")])

        for b in batches:
            x, at = whole_numbers(b, vec_col, d)
            ids, labels = (b.column(c).take(pa.array(at)) for c in (id_col, label_col))
            for i in range(0, len(x), shard_rows):
                j = min(i + shard_rows, len(x))
                held.append((x[i:j], ids[i:j].fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), np.asarray(ids[i:j].is_null()), labels[i:j].to_numpy(zero_copy_only=False).astype(np.int64)))
                size += j - i
                if size >= shard_rows:
                    yield close()
                    held, size, made = [], 0, made + 1
        if held:
            yield close()

    return run


class Anchors:
    """A batch of anchors: vectors, labels, and for each the windows of scores that it looks for (low, high), best k of each."""

    def __init__(self, rows: list, d: int, references: np.ndarray, same: bool, k: int):
        self.uid = np.array([r["uid"] for r in rows], np.int64)
        self.label = np.array([r["label"] for r in rows], np.int64)
        self.x = np.frombuffer(b"".join(r["x"] for r in rows), float).reshape(-1, d)
        self.norms = np.linalg.norm(self.x, axis=1)
        self.angles = angles(self.x, self.norms, references)
        self.same, self.k = same, k
        widest = max(len(r["windows"]) for r in rows) if rows else 0
        window = lambda c, none: np.array([[w[c] for w in r["windows"]] + [none] * (widest - len(r["windows"])) for r in rows], np.int64).reshape(len(rows), widest)
        self.low, self.high = window("low", (1 << 63) - 1), window("high", -(1 << 63))  # what is missing has no score
        self.least = self.low.copy()  # rises to the k-th best score found


class Shard:
    def __init__(self, row: dict, d: int, n_references: int):
        get = lambda c, kind: np.frombuffer(row[c], kind)
        self.uids, self.ids, self.nulls, self.labels = get("uids", np.int64), get("ids", np.int64), get("nulls", bool), get("labels", np.int64)
        self.x, self.norms = get("x", float).reshape(-1, d), get("norms", float)
        n = len(self.uids)
        self.angles = get("angles", float).reshape(n, n_references)
        ends = np.append(np.flatnonzero(np.diff(self.labels)) + 1, n)
        starts = np.concatenate([[0], ends[:-1]])
        self.at = np.concatenate([np.arange(a, b, BLOCK_ROWS) for a, b in zip(starts, ends, strict=True)])
        self.to = np.append(self.at[1:], n)
        self.block_label = self.labels[self.at]
        over = lambda f, c: f.reduceat(c, self.at, axis=0)
        self.least, self.most = (over(f, self.angles) for f in (np.minimum, np.maximum))
        self.small, self.large = (over(f, self.norms) for f in (np.minimum, np.maximum))


def score_bounds(theta: np.ndarray, norm: np.ndarray, least: np.ndarray, most: np.ndarray, small: np.ndarray, large: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For vectors at angles theta (a row each) and rows or blocks at angles from least to most (a row each) with norms from small to large: no
    score is below the first or above the second result."""
    near, far = np.zeros((len(theta), len(least))), np.full((len(theta), len(least)), np.pi)
    for r in range(theta.shape[1]):
        t = theta[:, r, None]
        np.maximum(near, np.maximum(least[None, :, r] - t, t - most[None, :, r]), out=near)
        np.minimum(far, np.minimum(t + most[None, :, r], 2 * np.pi - t - least[None, :, r]), out=far)
    low, high = np.cos(np.minimum(np.pi, far + SLACK)), np.cos(np.clip(near - SLACK, 0, np.pi))
    low = norm[:, None] * low * np.where(low < 0, large, small)
    high = norm[:, None] * high * np.where(high > 0, large, small)
    room = WIDER * norm[:, None] * large[None, :] + 1
    return np.floor(low - room), np.ceil(high + room)


def scores(a: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of all rows of a with all of x, as whole numbers: sums of float64 are exact below 2^53; larger ones are added up as Python's
    integers and cut to the range of a long."""
    if exact:
        return (a @ x.T).astype(np.int64)
    whole = lambda m: np.array([[int(c) for c in r] for r in m], object).reshape(m.shape)
    return np.clip(whole(a) @ whole(x).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def best_first(score, nulls, ids, uids):
    """Places in order: higher scores, then smaller ids, null ids last, repeated ids by place in the table."""
    return np.lexsort((uids, ids, nulls, -score.astype(float) if len(score) and score.min() == -(1 << 63) else -score))


def bring_up_to_date(shard: Shard, q: Anchors, best: list) -> None:
    """The best k rows of each window of each anchor, with this shard's rows."""
    if not len(q.uid):
        return
    lo, hi = score_bounds(q.angles, q.norms, shard.least, shard.most, shard.small, shard.large)
    wanted = (q.label[:, None] == shard.block_label[None, :]) == q.same
    exact = float(q.norms.max(initial=0) * shard.norms.max(initial=0)) < 1 << 52
    for c in np.argsort(-np.add.reduceat(hi.max(axis=0), range(0, len(shard.at), SPAN_BLOCKS)), kind="stable") * SPAN_BLOCKS:  # promising spans first
        span = slice(c, c + SPAN_BLOCKS)
        at, to = shard.at[c], shard.to[span][-1]
        rows = np.repeat(np.arange(len(shard.at[span])), shard.to[span] - shard.at[span])
        for w in range(q.low.shape[1]):  # blocks whose bounds meet the w-th window, above its threshold
            meets = wanted[:, span] & (hi[:, span] >= q.least[:, w, None]) & (lo[:, span] <= q.high[:, w, None])
            own = np.flatnonzero(meets.any(axis=1))
            for part in (own[i : i + GROUP_ANCHORS] for i in range(0, len(own), GROUP_ANCHORS)):
                s = scores(q.x[part], shard.x[at:to], exact)
                fits = meets[part][:, rows] & (s >= q.least[part, w, None]) & (s <= q.high[part, w, None])
                fits &= shard.uids[None, at:to] != q.uid[part, None]  # other rows
                many = np.flatnonzero(fits.sum(axis=1) > q.k)
                if len(many):  # only what is among the span's best k
                    among = np.where(fits[many], s[many], -(1 << 63))
                    fits[many] &= among >= np.partition(among, -q.k, axis=1)[:, -q.k, None]
                a, r = np.nonzero(fits)
                edge = np.searchsorted(a, np.arange(len(part) + 1))
                for i in np.flatnonzero(np.diff(edge)).tolist():
                    found = r[edge[i] : edge[i + 1]]
                    score, nulls, ids, uids = (np.concatenate(x) for x in zip(best[part[i]][w], (s[i, found], shard.nulls[at + found], shard.ids[at + found], shard.uids[at + found]), strict=True))
                    order = best_first(score, nulls, ids, uids)[: q.k]
                    best[part[i]][w] = score[order], nulls[order], ids[order], uids[order]
                    if len(order) == q.k:
                        q.least[part[i], w] = max(q.least[part[i], w], score[order[-1]])


def miner(batch, d: int, n_references: int):
    """A mapInArrow function over shards: for each window of each anchor of the broadcast batch, the best k rows of the task's shards."""

    def run(rows):
        q = copy.copy(batch.value)
        q.least = q.low.copy()
        none = (np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64), np.empty(0, np.int64))
        best = [[none] * q.low.shape[1] for _ in q.uid]
        for b in rows:
            for i in range(b.num_rows):
                bring_up_to_date(Shard({c: b.column(c)[i].as_buffer() for c in b.schema.names if c not in ("shard", "n_rows")}, d, n_references), q, best)
        flat = [(a, w, *x) for a, ws in enumerate(best) for w, x in enumerate(ws) if len(x[0])]
        if flat:
            own, place, score, nulls, ids, uids = zip(*flat, strict=True)
            n = [len(x) for x in score]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q.uid[list(own)], n)), pa.array(np.repeat(place, n).astype(np.int32)), pa.array(np.concatenate(score)), pa.array(np.concatenate(ids), mask=np.concatenate(nulls)), pa.array(np.concatenate(uids))], names=[c.split()[0] for c in FOUND.split(", ")])

    return run


def picked(ids: np.ndarray, nulls: np.ndarray, step: int) -> np.ndarray:
    return ~nulls & (ids % step == 0)


def anchor_rows(step: int, d: int):
    """A mapInArrow function over shards: the anchors among their rows."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                uids, ids, nulls, labels = (np.frombuffer(b.column(c)[i].as_buffer(), t) for c, t in (("uids", np.int64), ("ids", np.int64), ("nulls", bool), ("labels", np.int64)))
                at = np.flatnonzero(picked(ids, nulls, step))
                x = np.frombuffer(b.column("x")[i].as_buffer(), float).reshape(-1, d)
                yield pa.RecordBatch.from_arrays([pa.array(uids[at]), pa.array(ids[at]), pa.array(labels[at]), pa.array([x[j].tobytes() for j in at], pa.binary())], names=["uid", "anchor_id", "label", "x"])

    return run


def mine(df: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, anchor_step: int = ANCHOR_STEP, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", references: int = REFERENCES, shard_rows: int = SHARD_ROWS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the first `negatives` rows of another label for each anchor
    and each of its first `positives` rows of the same label.

    Vectors are floor(256 c); scores are inner products, whole numbers cut to a long's range. Anchors are the rows whose id is divisible by
    anchor_step; every row is searched, an anchor itself is none of its positives. A negative's score lies between low and high
    hundredths of the positive's (none can if that is negative). Higher scores come first, then smaller ids; null ids come last.

    Rows with a null label, a null or empty vector, a null, NaN or infinite entry, or another length than the most frequent one (ties: the
    longest) take no part. Rows that repeat an id are rows of their own, anchors too. An anchor without positives or negatives gives no rows.
    Other columns are dropped. An empty table gives no rows. A batch of anchors takes about `batch_bytes` of the driver and of each task; each is
    a pass over the rows, whose results are written before the next.
    """
    spark, d = df.sparkSession, dimension(df, vec_col)
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = df.filter(F.col(label_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("long").alias("_label"), F.col(vec_col).alias("_vector"))
    if not d:
        return spark.createDataFrame([], out)

    def wide(batches):
        for b in batches:
            x, at = whole_numbers(b, "_vector", d)
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in x], pa.binary())], names=["x"])

    fine = ~F.exists("_vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & (F.size("_vector") == d)
    sample = rows.filter(fine).orderBy(F.xxhash64("_vector"), "_id").limit(SAMPLE_ROWS).select("_vector").mapInArrow(wide, "x binary").collect()
    directions = references_of(np.frombuffer(b"".join(r["x"] for r in sample), float).reshape(-1, d), references)
    index = durable(rows.mapInArrow(index_shards("_id", "_label", "_vector", d, directions, shard_rows), INDEX))
    n_shards = index.count()
    tasks = index.coalesce(max(1, -(-n_shards // TASK_SHARDS)))
    anchors = durable(index.mapInArrow(anchor_rows(anchor_step, d), "uid long, anchor_id long, label long, x binary"))

    def passes(asked: DataFrame, same: bool, k: int) -> DataFrame:
        """Runs the anchors (uid, label, x, windows) against all shards, batch by batch, and keeps the best k rows of each window."""
        n = asked.count()
        n_batches = max(1, -(-n * (16 * d + 512) * 5 // (4 * batch_bytes))) if n * (16 * d + 512) > batch_bytes else 1
        root = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        rank = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.asc_nulls_last("id"), "uid"))
        for i in range(n_batches):
            part = asked.filter(F.pmod(F.xxhash64("uid"), F.lit(n_batches)) == i).collect()  # about batch_bytes
            batch = spark.sparkContext.broadcast(Anchors(part, d, directions, same, k))
            tasks.mapInArrow(miner(batch, d, len(directions)), FOUND).withColumn("rank", rank).filter(F.col("rank") <= k).write.parquet(f"{root}/{i}")
            batch.destroy()
        return spark.read.schema(FOUND + ", rank int").option("recursiveFileLookup", "true").parquet(root)

    window = lambda lo, hi: F.struct(lo.cast("long").alias("low"), hi.cast("long").alias("high"))
    ends = F.array(window(F.lit(-(1 << 63)), F.lit((1 << 63) - 1)))
    found = passes(anchors.withColumn("windows", ends), True, positives)
    # low * positive <= 100 * negative <= high * positive, in whole numbers; the products may leave a long
    share = lambda hundredths: F.col("score").cast("decimal(20,0)") * hundredths / 100
    given = found.select("anchor", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.ceil(share(low)).cast("long").alias("low"), F.floor(share(high)).cast("long").alias("high")).filter("low <= high")
    given = durable(given)
    each = given.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "low", "high"))).alias("windows"))  # at most `positives`
    asked = durable(anchors.join(each, F.col("uid") == F.col("anchor")).select("uid", "anchor_id", "label", "x", "windows"))
    hard = passes(asked.select("uid", "label", "x", "windows"), False, negatives)
    of = asked.select("uid", "anchor_id", F.posexplode("windows")).select(F.col("uid").alias("anchor"), "anchor_id", F.col("pos").alias("window"), F.col("col.place").alias("place"))
    return hard.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).drop("uid").join(of, ["anchor", "window"]).join(given, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def relabelled(df: DataFrame) -> DataFrame:
    """Every seventh id gets the next label, so that near vectors of another label are there to be found."""
    return df.withColumn("label", F.when(F.col("vec_id") % RELABEL_STEP == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")))


def op13_negatives(spark, sf_dir: str) -> DataFrame:
    return mine(relabelled(table(spark, sf_dir, "embeddings")))


SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
"""
