"""Exact top-k BM25 search: one inverted index for each shard of the documents, block-max WAND pruning, an exact merge.

A shard is a run of documents that one task indexes: sorted term hashes, postings (document, frequency), lengths. Document frequencies
and lengths are added up over all shards, so every shard scores with the global statistics. Within a shard documents stand in the order of
their most widespread term (their language, by and large) and length, so that blocks of neighbours have tight maxima.

Queries go to all tasks in batches of bounded size, one batch after another. A task reads its shards one by one and keeps each query's
best k and their least score, the threshold, from shard to shard. For a query the maxima of its terms, frequent ones too, in each block of
documents are added up; blocks whose sum stays below the threshold are skipped, and the threshold rises from one span of blocks to the next.
The pivot test of WAND is thus made for a block at a time and for many queries at once, which suits numpy better than a cursor for each term.
"""

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm import kernels as K
from lodestone.llm.common import durable, narrow, setting, shared_dir, ships, slices, table, wide

ships(__name__)

TOP, K1, B = 10, 1.2, 0.75
SHARD_BYTES = 8 << 20
#: Shards that a task takes one after another, and packed bytes of queries that go to all tasks at once.
TASK_SHARDS, BATCH_BYTES = 4, 16 << 20
#: Documents in a block, blocks in a span, queries that are taken at once.
BLOCK_DOCS, SPAN_BLOCKS, GROUP_QUERIES = 16, 32, 128
#: Terms in one of DENSE documents, for bounds in one of WIDE blocks, of a shard and more are laid out as matrix rows.
DENSE, WIDE = 24, 8
#: Sums of float32 decide what is looked at; with a factor they are upper bounds: this one, or more for queries whose terms are so many that the
#: rounding of their sum (at most EACH for a term) can exceed it. What is looked at is added up in float64.
ROUNDING, EACH = 1.001, 1.2e-7
DIGITS = 6
QUERY_STEP = 50

INDEX = "shard long, n_docs long, n_words long, terms binary, dfs binary, docs binary, tfs binary, ids binary, nulls binary, lens binary"
#: A shard is a row of some MB. Written with a page a row and few rows a row group, and sent to Python one by one, it passes through the JVM alone:
#: else readers and Arrow hold all shards of a file at once, several times over, beside the heap too.
ONE_BY_ONE = {"parquet.page.row.count.limit": "1", "parquet.block.size": str(4 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
FOUND = "query_id long, doc_id long, score double"


def postings(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(term, document, frequency) of a slice, and the documents' lengths in words."""
    h, first = K.words(data, offs)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n), dtype=np.int64), n)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return h[at], doc[at], np.diff(np.concatenate([at, [len(h)]])), n


def index_shards(id_col: str, shard_bytes: int):
    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        held, size, n, made = [], 0, 0, 0

        def close():
            h, doc, tf, lens, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            terms, number, df = np.unique(h, return_inverse=True, return_counts=True)
            rank = np.empty(len(df), np.int32)
            rank[np.argsort(-df, kind="stable")] = np.arange(len(df), dtype=np.int32)
            widest = np.full(len(lens), len(df), np.int32)
            np.minimum.at(widest, doc, rank[number])
            by = np.lexsort((lens, widest))
            place = np.empty(len(lens), np.int32)
            place[by] = np.arange(len(lens), dtype=np.int32)
            doc = place[doc]
            order = np.lexsort((doc, number))
            lens, ids = lens[by], ids[by]
            null = np.array([x is None for x in ids], bool)
            plain = np.array([0 if x is None else x for x in ids], np.int64)
            cols = [terms, narrow(df), narrow(doc[order]), narrow(tf[order]), plain, null, narrow(lens)]
            return pa.RecordBatch.from_arrays([pa.array([task * (1 << 20) + made]), pa.array([len(lens)]), pa.array([int(lens.sum())]), *(pa.array([c.tobytes()], pa.binary()) for c in cols)], names=[x.split()[0] for x in INDEX.split(", ")])

        for b in batches:
            ids = np.array(b.column(id_col).to_pylist(), object)
            for row, data, offs in slices(b, "text"):
                h, doc, tf, lens = postings(data, offs)
                held.append((h, (doc + n).astype(np.int32), tf.astype(np.int32), lens, ids[row : row + len(lens)]))
                n, size = n + len(lens), size + len(data)
                if size >= shard_bytes:
                    yield close()
                    held, size, n, made = [], 0, 0, made + 1
        if held:
            yield close()

    return run


def product(holds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """holds @ rows, by the rows that any query holds."""
    held = np.flatnonzero(holds.any(axis=0))
    return holds[:, held] @ rows[held]


class Shard:
    """One index row, for a batch of queries: postings with what they add to a score (idf times impact), and block maxima of that."""

    def __init__(self, row: dict, queries: "Queries", mean: float):
        get = lambda c, kind: np.frombuffer(row[c], kind)
        terms, self.ids, self.nulls = get("terms", np.uint64), get("ids", np.int64), get("nulls", bool)
        df, lens = wide(row["dfs"], len(terms)), wide(row["lens"], len(self.ids)).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(df, dtype=np.int64)])
        self.docs, tf = wide(row["docs"], self.starts[-1]).astype(np.int32), wide(row["tfs"], self.starts[-1]).astype(np.int32)
        self.n, self.n_blocks = len(lens), -(-len(lens) // BLOCK_DOCS)
        place = K.lookup(terms, queries.terms)
        has = np.flatnonzero(place)
        self.asked, self.edge = (place[has] - 1).astype(np.int32), np.searchsorted(has, queries.starts)  # query i's terms: asked[edge[i] : edge[i + 1]]
        idf = np.zeros(len(terms))
        idf[self.asked] = queries.idf[has]
        norm = K1 * (1 - B + B * lens / mean)
        self.value = np.repeat(idf, np.diff(self.starts)) * (tf * (K1 + 1) / (tf + norm[self.docs]))
        block = self.docs // BLOCK_DOCS
        new = np.ones(len(block), bool)
        new[1:] = block[1:] != block[:-1]
        new[self.starts[:-1]] = True
        at = np.flatnonzero(new)
        self.block, self.most = block[at], np.maximum.reduceat(self.value, at) if len(at) else np.empty(0)
        self.entries = np.searchsorted(at, self.starts)
        # what many documents or blocks hold is laid out as rows of a matrix, for many queries at once
        self.dense, self.values = self.matrix((np.diff(self.starts) * DENSE >= self.n) & (idf > 0), self.starts, self.docs, self.value, self.n, np.float64)
        self.wide, maxima = self.matrix((np.diff(self.entries) * WIDE >= self.n_blocks) & (idf > 0), self.entries, self.block, self.most, self.n_blocks, np.float32)
        self.near, self.maxima = self.values.T.astype(np.float32, order="C"), np.ascontiguousarray(maxima.T)
        self.rounding = np.float32(max(ROUNDING, 1 + EACH * np.diff(queries.starts).max(initial=0)))

    @staticmethod
    def matrix(often: np.ndarray, starts: np.ndarray, column: np.ndarray, value: np.ndarray, n: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """The number of each term (-1: none), and a row of their values for each document or block."""
        row = np.full(len(often), -1, np.int32)
        terms = np.flatnonzero(often)
        row[terms] = np.arange(len(terms))
        pos, which = K.spread(starts[terms], starts[terms + 1])
        out = np.zeros((n, len(terms)), kind)
        out[column[pos], which] = value[pos]
        return row, out

    def sums(self, lo: int, of: np.ndarray, row: np.ndarray, starts: np.ndarray, column: np.ndarray, value: np.ndarray, n_rows: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For the queries lo + of: which rows of a matrix they hold (1 or 0), and the sums over their other terms by column."""
        at, query = K.spread(self.edge[lo + of], self.edge[lo + of + 1])
        terms = self.asked[at]
        r = row[terms]
        holds = np.zeros((len(of), n_rows), np.float32)
        holds[query[r >= 0], r[r >= 0]] = 1
        t, query = terms[r < 0], query[r < 0]
        m = starts[t + 1] - starts[t]
        pos = np.repeat(starts[t] - (np.cumsum(m) - m), m)
        pos += np.arange(len(pos))
        cell = np.repeat(query * np.int64(n), m)
        cell += column[pos]
        return holds, np.bincount(cell, value[pos], len(of) * n).reshape(len(of), n)

    def search(self, lo: int, hi: int, best: list, k: int) -> None:
        """Brings the best k of the queries lo to hi up to date with this shard's documents.

        A span of blocks after the other: queries for which no block's bound reaches their threshold pass over it.
        """
        margin = 10.0**-DIGITS  # ranks go by rounded scores
        every = np.arange(hi - lo)
        holds, rest = self.sums(lo, every, self.wide, self.entries, self.block, self.most, len(self.maxima), self.n_blocks)
        bound = product(holds, self.maxima) + rest
        bound *= self.rounding
        least = np.array([x[0][-1] if len(x[0]) == k else 0.0 for x in best[lo:hi]])
        every = np.flatnonzero(((bound >= least[:, None] - margin) & (bound > 0)).any(axis=1))  # the others have no open block in this shard
        if not len(every):
            return
        bound, least = bound[every], least[every]
        holds, rest = self.sums(lo, every, self.dense, self.starts, self.docs, self.value, len(self.near), self.n)
        held = np.flatnonzero(holds.any(axis=0))
        exact, holds, nearly, about = holds.astype(np.float64), holds[:, held], self.near[held], rest.astype(np.float32)
        for a in range(0, self.n_blocks, SPAN_BLOCKS):
            open_ = (bound[:, a : a + SPAN_BLOCKS] >= least[:, None] - margin) & (bound[:, a : a + SPAN_BLOCKS] > 0)
            own = np.flatnonzero(open_.any(axis=1))
            if not len(own):
                continue
            docs = slice(a * BLOCK_DOCS, min(self.n, (a + SPAN_BLOCKS) * BLOCK_DOCS))
            near = holds[own] @ nearly[:, docs]
            near += about[own, docs]
            near *= self.rounding
            found = np.repeat(open_[own], BLOCK_DOCS, axis=1)[:, : near.shape[1]] & (near >= least[own, None] - margin) & (near > 0)
            if near.shape[1] > k:
                found &= np.maximum(near * self.rounding, near + margin) >= np.partition(near, -k, axis=1)[:, -k, None]
            q, d = np.nonzero(found)
            score = rest[own[q], docs.start + d] + np.einsum("ij,ij->i", exact[own[q]], self.values[docs.start + d])
            d, q, score = (x[score >= least[own[q]] - margin] for x in (d, q, score))
            edge = np.searchsorted(q, np.arange(len(own) + 1))
            for j in np.flatnonzero(np.diff(edge)).tolist():
                i, place = lo + int(every[own[j]]), d[edge[j] : edge[j + 1]] + docs.start
                new = np.round(score[edge[j] : edge[j + 1]], DIGITS)
                new, named, ids = np.concatenate([best[i][0], new]), np.concatenate([best[i][1], ~self.nulls[place]]), np.concatenate([best[i][2], self.ids[place]])
                order = np.lexsort((ids, named, -new))[:k]
                best[i] = new[order], named[order], ids[order]
                if len(order) == k:
                    least[own[j]] = new[order[-1]]


class Queries:
    """A batch of queries: ids, and the terms and weights of query i at starts[i] to starts[i + 1].

    They stand by their most widespread term (their language, by and large) and number of terms, so that a group's queries hold the same terms
    and pass over the same blocks."""

    def __init__(self, rows: list, n_docs: int):
        def widest(r):
            terms, df = np.frombuffer(r["terms"], np.uint64), np.frombuffer(r["dfs"], np.int64)
            return int(terms[np.argmax(df)]) if len(df) else 0

        rows = sorted(rows, key=lambda r: (widest(r), len(r["terms"])))
        self.ids = np.array([r["query_id"] for r in rows], np.int64)
        self.starts = np.concatenate([[0], np.cumsum([len(r["terms"]) // 8 for r in rows])]).astype(np.int64)
        self.terms = np.frombuffer(b"".join(r["terms"] for r in rows), np.uint64)
        df = np.frombuffer(b"".join(r["dfs"] for r in rows), np.int64)
        self.idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def searcher(batch, mean: float, k: int):
    """A mapInArrow function over index rows: the best k documents of the task's shards for each query of the broadcast batch."""

    def run(rows):
        q = batch.value
        best: list = [(np.empty(0), np.empty(0, bool), np.empty(0, np.int64))] * len(q.ids)  # scores, is-not-null, ids; in order
        for b in rows:
            for row in range(b.num_rows):
                shard = Shard({c: b.column(c)[row].as_buffer() for c in b.schema.names if c not in ("shard", "n_docs", "n_words")}, q, mean)
                for lo in range(0, len(q.ids), GROUP_QUERIES):
                    shard.search(lo, min(lo + GROUP_QUERIES, len(q.ids)), best, k)
                shard = None  # before the next one is built
        n = [len(x[0]) for x in best]
        if sum(n):
            score, named, ids = (np.concatenate(x) for x in zip(*best, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q.ids, n)), pa.array(ids, mask=~named), pa.array(score)], names=["query_id", "doc_id", "score"])

    return run


def packed_queries(batches):
    """(query_id, t: terms with their document frequencies) with the terms and frequencies as binary."""
    for b in batches:
        t = b.column("t")
        offs, flat = t.offsets.to_numpy(), t.values
        term, df = (flat.field(c).to_numpy() for c in ("term", "df"))
        each = [(term[i:j].tobytes(), df[i:j].tobytes()) for i, j in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("query_id"), *(pa.array(x, pa.binary()) for x in zip(*each, strict=True))] if each else [b.column("query_id"), pa.array([], pa.binary()), pa.array([], pa.binary())], names=["query_id", "terms", "dfs"])


def term_rows(batches):
    for b in batches:
        for row in range(b.num_rows):
            terms = np.frombuffer(b.column("terms")[row].as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(wide(b.column("dfs")[row].as_buffer(), len(terms)).astype(np.int64))], names=["term", "n"])


def query_terms(batches):
    for b in batches:
        ids = b.column("query_id").to_numpy()
        for row, data, offs in slices(b, "text"):
            h, doc, _, _ = postings(data, offs)
            yield pa.RecordBatch.from_arrays([pa.array(ids[row + doc]), pa.array(h.view(np.int64))], names=["query_id", "term"])


def search(docs: DataFrame, queries: DataFrame, k: int = TOP, id_col: str = "doc_id", shard_bytes: int = SHARD_BYTES, batch_bytes: int = BATCH_BYTES, task_shards: int = TASK_SHARDS) -> DataFrame:
    """(query_id, rank, doc_id, score): the best k documents of each query (query_id, text) by BM25 over distinct query terms.

    Scores are rounded to 6 places; ties go to the smaller id, null ids first. Documents without a query term aren't returned; null and empty
    texts have no terms. Rows that repeat a document id are documents of their own; texts that share a query id are one query;
    null query ids are left out. Other columns are dropped. Ids are whole numbers. A batch of queries takes about `batch_bytes` of
    the driver and of each task (or one query, if that is larger); each is one pass over the index, whose results are written before the next.
    """
    spark = docs.sparkSession
    index = durable(docs.select(F.col(id_col).cast("long").alias("_id"), "text").mapInArrow(index_shards("_id", shard_bytes), INDEX), ONE_BY_ONE)
    total = index.agg(F.count("*").alias("shards"), F.sum("n_docs").alias("n"), F.sum("n_words").alias("w")).first()
    n_docs, mean = total["n"] or 0, max(1e-9, (total["w"] or 0) / max(1, total["n"] or 0))
    asked = durable(queries.filter("query_id IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), "text").mapInArrow(query_terms, "query_id long, term long").distinct())
    df = index.select("terms", "dfs").mapInArrow(term_rows, "term long, n long").join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    each = asked.join(df, "term").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", "df"))).alias("t"))
    each = durable(each.mapInArrow(packed_queries, "query_id long, terms binary, dfs binary"))
    size = each.agg(F.sum(F.length("terms") + F.length("dfs") + 64)).first()[0] or 0
    n_batches = -(-5 * size // (4 * batch_bytes)) if size > batch_bytes else 1  # with room for uneven shares
    root = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
    for n in range(n_batches):
        rows = each.filter(F.pmod(F.xxhash64("query_id"), F.lit(n_batches)) == n).collect()  # about batch_bytes
        batch = spark.sparkContext.broadcast(Queries(rows, n_docs))
        found = index.coalesce(max(1, -(-total["shards"] // task_shards))).mapInArrow(searcher(batch, mean, k), FOUND)
        with setting(spark, ARROW_ROWS, "1"):
            found.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score").write.parquet(f"{root}/{n}")
        batch.destroy()
    return spark.read.schema("query_id long, rank long, doc_id long, score double").option("recursiveFileLookup", "true").parquet(root)


def op3_search(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search(docs, docs.filter(F.col("doc_id") % QUERY_STEP == 0).withColumnRenamed("doc_id", "query_id"))


SQL = r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM w GROUP BY doc_id, term),
l AS (SELECT d.doc_id, coalesce(n, 0)::DOUBLE AS len FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id) USING (doc_id)),
g AS (SELECT count(*)::DOUBLE AS n, avg(len) AS mean FROM l),
f AS (SELECT term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, g GROUP BY term),
s AS (SELECT q.doc_id AS query_id, p.doc_id, round(sum(idf * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score
      FROM p q JOIN p USING (term) JOIN f USING (term) JOIN l ON l.doc_id = p.doc_id, g WHERE q.doc_id % 50 = 0 GROUP BY q.doc_id, p.doc_id)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s) WHERE rank <= 10
"""
