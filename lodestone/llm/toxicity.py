"""Toxicity by maximum-scoring segments.

Tokens are words and their beginnings (5 to 7 bytes of UTF-8, which reach inflected forms). Training counts, over distinct labelled texts,
how many toxic and other documents hold each token; the log-odds with an informative Dirichlet prior (Monroe et al. 2008) give a
lexicon of tokens that mark toxic text. A word scores its best token's log-odds, any other word a small loss. All maximal scoring segments
of a document are found in linear time (Ruzzo and Tompa 1999) and judged by Karlin-Altschul statistics: the decay rate comes from
the words of clean documents, a segment of score S in n words has log evidence lambda S - ln n, and a document has the sum over its
significant segments (or the best one, if none is). The training rows, each scored by a lexicon from the other folds, place the decision between
the classes.

Documented bound: the classifier is fitted on at most `train_rows` labelled documents (by md5 of the id), which bounds its lexicon
too; every token that passes the tests is kept. All documents are scored, over their whole texts.
"""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.llm import kernels as K
from lodestone.llm.common import durable, ships, slices, table, text_hash

ships(__name__)

TRAIN_ROWS = 20_000
BEGINNINGS = (5, 6, 7)
FOLDS = (1, 2, 3, 4)
LOSS, LEAST_Z, LEAST_ODDS, LEAST_DOCS, PRIOR = 0.2, 3.0, 2.5, 3, 0.1
#: Log evidence of a document without any lexicon token: below that of one token amid thousands of words.
NO_EVIDENCE = -10.0
BIN = 20  # histogram bins for one unit of log evidence

SCORED = "score double, predicted int, segments array<struct<start:int,end:int,evidence:double>>"


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of each word and of its beginnings (0 where it is too short); each document's first word."""
    low = K.WORD[data]
    s, e = K.word_places(low, offs)
    out = [np.zeros(len(s), np.uint64) for _ in range(1 + len(BEGINNINGS))]
    for i, j, a, b in K.pieces(low, s, e):
        p, at, to = K.prefixes(low[a:b]), s[i:j] - a, e[i:j] - a
        inv = K.powers(K.R_INV, b - a + 1)[at]
        out[0][i:j] = K.mixed((p[to] - p[at]) * inv + (to - at).astype(np.uint64))
        for f, k in zip(out[1:], BEGINNINGS, strict=True):
            f[i:j] = np.where(to - at < k, np.uint64(0), K.mixed((p[np.minimum(to, at + k)] - p[at]) * inv + np.uint64(1000 + k)))
    return out, np.searchsorted(s, offs)


def features(batches):
    """A row for each document and distinct token: f, toxic, fold."""
    for b in batches:
        toxic, fold = b.column("toxic").to_numpy(), b.column("fold").to_numpy()
        for row, data, offs in slices(b, "text"):
            found, first = tokens(data, offs)
            doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
            f, d = np.concatenate(found), np.concatenate([doc] * len(found))
            order = np.lexsort((f, d))
            f, d = f[order], d[order]
            new = np.ones(len(f), bool)
            new[1:] = (f[1:] != f[:-1]) | (d[1:] != d[:-1])
            new &= f != 0
            f, d = f[new], d[new] + row
            yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(toxic[d]), pa.array(fold[d])], names=["f", "toxic", "fold"])


def lexicon(counts: DataFrame, n1: int, n0: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted token hashes and their log-odds, from (f, a, b): toxic and other documents with the token."""
    total = PRIOR * (n1 + n0)
    w = (F.col("a") + F.col("b")) / (n1 + n0) * total
    a, b = F.col("a") + w, F.col("b") + w
    odds = F.log(a / (n1 + total - a)) - F.log(b / (n0 + total - b))
    z = F.col("odds") / F.sqrt(1 / a + 1 / b)
    rows = counts.filter(F.col("a") >= LEAST_DOCS).withColumn("odds", odds).withColumn("z", z).filter((F.col("z") >= LEAST_Z) & (F.col("odds") >= LEAST_ODDS))
    rows = rows.select("f", "odds").collect()  # tokens of the training rows that mark toxic text
    f, v = np.array([r["f"] for r in rows], np.int64).view(np.uint64), np.array([r["odds"] for r in rows], float)
    order = np.argsort(f)
    return f[order], np.concatenate([[0.0], v[order]])


def segments(at: list[int], gain: list[float], loss: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), given the places that gain and what they gain; every other place loses.

    Ruzzo and Tompa's algorithm over the places that gain: the losses between them are added at once.
    """
    total, last = 0.0, 0
    held: list[list] = []  # start, end, total before, total after
    for p, g in zip(at, gain, strict=True):
        total -= loss * (p - last)
        new = [p, p + 1, total, total + g]
        total, last = total + g, p + 1
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= new[2]:
                j -= 1
            if j < 0 or held[j][3] >= new[3]:
                break
            new = [held[j][0], new[1], held[j][2], new[3]]
            del held[j:]
        held.append(new)
    return [(s, e, r - l) for s, e, l, r in held]


def evidence(lex: tuple, rate: float, data: np.ndarray, offs: np.ndarray):
    """For each document its log evidence and significant segments."""
    keys, gains = lex
    found, first = tokens(data, offs)
    n = len(offs) - 1
    length = [math.log(x + 2) for x in np.diff(first)]
    value = NO_EVIDENCE - np.array(length)
    sure: list = [[] for _ in range(n)]
    if len(found[0]):
        best = gains[K.lookup(keys, found[0])]
        for f in found[1:]:
            np.maximum(best, gains[K.lookup(keys, f)], out=best)
        hit = np.flatnonzero(best > 0)
        doc = np.searchsorted(first, hit, "right") - 1
        edge = np.searchsorted(doc, np.arange(n + 1))
        for d in np.flatnonzero(np.diff(edge)).tolist():
            h = hit[edge[d] : edge[d + 1]]
            ev = [(s, e, rate * x - length[d]) for s, e, x in segments((h - first[d]).tolist(), best[h].tolist(), LOSS)]
            sure[d] = [x for x in ev if x[2] > 0]
            value[d] = sum(x[2] for x in sure[d]) or max(x[2] for x in ev)
    return value, sure


def decay(lex: tuple, clean: DataFrame) -> float:
    """Karlin and Altschul's lambda of a clean document's words: sum of p(s) exp(lambda s) = 1."""
    keys, gains = lex
    if not len(keys):
        return 1.0

    def run(batches):
        for b in batches:
            for _, data, offs in slices(b, "text"):
                found, first = tokens(data, offs)
                best = np.zeros(len(found[0]))
                for f in found:
                    np.maximum(best, gains[K.lookup(keys, f)], out=best)
                s, n = np.unique(np.round(best, 1), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(n)], names=["s", "n"])

    rows = clean.select("text").mapInArrow(run, "s double, n long").groupBy("s").agg(F.sum("n").alias("n")).collect()  # scores in tenths: few
    s, n = np.array([r["s"] for r in rows] or [0.0]), np.array([r["n"] for r in rows] or [1], float)
    p, s = n / n.sum(), np.where(s > 0, s, -LOSS)
    if (p * s).sum() >= 0 or s.max() <= 0:
        return 1.0
    lo, hi = 1e-3, 4.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (p * np.exp(mid * s)).sum() < 1 else (lo, mid)
    return min(max(lo, 0.1), 2.0)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id"):
    """(lexicon, lambda, cut): what scoring needs. Learns only from labels whose crc32(id as text) mod 5 is not 0."""
    fold = F.pmod(F.crc32(F.col("_id").cast("string")), F.lit(5))
    marked = labels.select(F.col("doc_id").alias("_id"), "toxic").filter("toxic IS NOT NULL AND _id IS NOT NULL").groupBy("_id").agg(F.max("toxic").cast("int").alias("toxic")).filter(fold != 0)
    slim = docs.select(F.col(id_col).alias("_id"), text_hash().alias("_h"))
    picked = slim.join(marked, "_id").groupBy("_h").agg(F.min("_id").alias("_id"), F.max("toxic").alias("toxic")).orderBy(F.md5(F.col("_id").cast("string")), "_id").limit(train_rows)
    picked = durable(picked.withColumn("fold", fold.cast("int")))
    texts = docs.select(F.col(id_col).alias("_id"), "text").withColumn("_h", text_hash())
    train = durable(texts.join(F.broadcast(picked), ["_id", "_h"]).dropDuplicates(["_id", "_h"]).select("text", "toxic", "fold"))  # at most train_rows
    counts = train.mapInArrow(features, "f long, toxic int, fold int").groupBy("f").agg(*[F.count_if((F.col("toxic") == t) & (F.col("fold") == k)).alias(f"n{t}{k}") for t in (0, 1) for k in FOLDS])
    counts = durable(counts.filter(sum((F.col(f"n1{k}") for k in FOLDS[1:]), F.col(f"n1{FOLDS[0]}")) >= LEAST_DOCS))
    n = {(r["toxic"], r["fold"]): r["count"] for r in train.groupBy("toxic", "fold").count().collect()}

    def without(k):
        own = [x for x in FOLDS if x != k]
        return lexicon(counts.selectExpr("f", " + ".join(f"n1{x}" for x in own) + " AS a", " + ".join(f"n0{x}" for x in own) + " AS b"), *(sum(n.get((t, x), 0) for x in own) for t in (1, 0)))

    full, early = without(None), {k: without(k) for k in FOLDS}
    rate = decay(full, train.filter("toxic = 0"))

    def run(batches):
        for b in batches:
            for k in FOLDS:
                own = b.filter(pc.equal(b.column("fold"), k))
                for row, data, offs in slices(own, "text"):
                    v, _ = evidence(early[k], rate, data, offs)
                    yield pa.RecordBatch.from_arrays([pa.array(np.clip(np.round(v * BIN), -40 * BIN, 40 * BIN).astype(np.int64)), own.column("toxic").slice(row, len(v))], names=["bin", "toxic"])

    bins = train.mapInArrow(run, "bin long, toxic int").groupBy("bin").agg(F.count_if(F.col("toxic") == 1).alias("n1"), F.count_if(F.col("toxic") == 0).alias("n0")).collect()  # at most 80 * BIN
    return full, rate, cut(sorted((r["bin"] / BIN, r["n1"], r["n0"]) for r in bins))


def cut(bins: list[tuple[float, int, int]]) -> float:
    """The log evidence from which on a document counts as toxic: fewest errors, of such gaps the widest, in it the place nearest
    to 0 (one segment expected by chance) of its middle half; 0 without toxic rows."""
    at = [b[0] for b in bins]
    gaps = list(zip(at, at[1:], strict=False))
    errors = lambda t: sum(n1 if v < t else n0 for v, n1, n0 in bins)
    if not gaps or not sum(b[1] for b in bins):
        return 0.0
    x, y = min(gaps, key=lambda g: (errors((g[0] + g[1]) / 2), g[0] - g[1]))
    return min(max(0.0, x + (y - x) / 4), y - (y - x) / 4)


def score(docs: DataFrame, model: tuple) -> DataFrame:
    """docs with score, predicted and segments (word places, log evidence) by a model of fit(). Clashing columns are replaced."""
    full, rate, at = model
    base = docs.drop(*[x.split()[0] for x in SCORED.split(", ")])

    def run(batches):
        for b in batches:
            for row, data, offs in slices(b, "text"):
                v, sure = evidence(full, rate, data, offs)
                p = 1 / (1 + np.exp(-np.clip(v - at, -30, 30)))
                cols = [pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array([[{"start": s, "end": e, "evidence": x} for s, e, x in r] for r in sure], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("evidence", pa.float64())])))]
                yield pa.RecordBatch.from_arrays(b.slice(row, len(v)).columns + cols, names=[*b.schema.names, "score", "predicted", "segments"])

    return base.mapInArrow(run, StructType(base.schema.fields + StructType.fromDDL(SCORED).fields))


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id") -> DataFrame:
    """docs with score (0 to 1), predicted (score >= 0.5) and the significant segments.

    Null and empty texts have no token and the score of no evidence. Without labels or toxic examples the lexicon is empty. Labels repeated for an
    id count as toxic if one is; null labels and ids aren't learnt from. Repeated rows get equal scores.
    """
    return score(docs, fit(docs, labels, train_rows, id_col))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    return toxicity(docs, table(spark, sf_dir, "labels")).select("doc_id", held.alias("held_out"), "score", "predicted")
