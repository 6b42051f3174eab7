"""Benchmark decontamination by suffix arrays of the training text.

Each task takes slices of whole documents as shards. Of a shard's words it keeps those runs that consist of benchmark words alone
(no window can lie elsewhere), sorts their suffixes, and binary-searches every suffix of every test item, a word at a time for all
of them at once. That gives each test suffix's longest verbatim match and its locations; suffixes matched over a whole window mark
the words they cover. Documents stay where they are read: there is no shuffle.

The benchmark goes to the tasks in blocks of at most `block_bytes` of text (the stated query set, in blocks); more than one block
means one more pass a block and a merge by document.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.llm import kernels as K
from lodestone.llm.common import ships, slices, table, text_hash

ships(__name__)

WINDOW = 10
BLOCK_BYTES = 8 << 20


class Tests:
    """The suffixes of a block of test items, as word numbers."""

    def __init__(self, ids: list, texts: list[str], window: int):
        data = [t.encode() for t in texts]
        offs = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
        h, first = K.words(np.frombuffer(b"".join(data), np.uint8), offs)
        self.vocab = np.unique(h)
        n = np.diff(first)
        self.item = np.repeat(np.arange(len(ids)), n)
        left = np.repeat(first[1:], n) - np.arange(len(h))  # words from here to the item's end
        self.words = np.concatenate([K.lookup(self.vocab, h), [0]])
        self.left = left
        self.window = np.minimum(window, np.repeat(n, n))
        self.tests = np.flatnonzero(left >= self.window)  # the suffixes that hold a window
        self.ids = ids
        self.least = int(self.window[self.tests].min()) if len(self.tests) else 0


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of t by their first `depth` symbols at least; prefix doubling."""
    rank, step = t.astype(np.int64), 1
    while step < depth:
        nxt = np.zeros_like(rank)
        nxt[:-step] = rank[step:] + 1
        rank = np.unique(rank * (int(nxt.max()) + 1) + nxt, return_inverse=True)[1]
        if rank.max() == len(rank) - 1:
            break
        step *= 2
    return np.argsort(rank, kind="stable")


def bound(t, sa, at, lo, hi, word, right: bool):
    """Binary search of all ranges [lo, hi) of sa at once, by the symbol `at` places into the suffix."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        x = t[np.minimum(sa[np.minimum(mid, len(sa) - 1)] + at, len(t) - 1)]
        go = open_ & ((x <= word) if right else (x < word))
        lo = np.where(go, mid + 1, lo)
        hi = np.where(open_ & ~go, mid, hi)
    return lo


def matches(tests: Tests, t: np.ndarray):
    """(suffix, position in t) of every test suffix that is found over its whole window; positions and lengths of the longest matches."""
    sa = suffix_array(t, int(tests.left.max()))
    q = tests.tests
    lo, hi = np.zeros(len(q), np.int64), np.full(len(q), len(t), np.int64)
    found, ends, j = [], [], 0
    while len(q):
        w = tests.words[q + j]
        was = lo, hi
        lo, hi = bound(t, sa, j, lo, hi, w, False), bound(t, sa, j, lo, hi, w, True)
        live = hi > lo
        over = ~live & (tests.window[q] <= j)  # its longest match ended a word before
        ends.append((sa[K.spread(was[0][over], was[1][over])[0]], j))
        q, lo, hi = q[live], lo[live], hi[live]
        j += 1
        done = tests.window[q] == j
        pos, which = K.spread(lo[done], hi[done])
        found.append((q[done][which], sa[pos]))
        over = tests.left[q] == j
        ends.append((sa[K.spread(lo[over], hi[over])[0]], j))
        q, lo, hi = q[~over], lo[~over], hi[~over]
    at = np.concatenate([x[0] for x in ends])
    length = np.repeat([x[1] for x in ends], [len(x[0]) for x in ends])
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]), at, length


def shard(tests: Tests, data: np.ndarray, offs: np.ndarray):
    """Words by document, its first word, covered word places (sorted), (document, item) pairs, and each document's longest match."""
    h, first = K.words(data, offs)
    n_words, none = np.diff(first), np.empty(0, np.int64)
    longest = np.zeros(len(n_words), np.int64)
    if not tests.least or not len(h):
        return n_words, first, none, none, none, longest
    w = K.lookup(tests.vocab, h)
    stop = w == 0
    cut = np.zeros(len(w) + 1, bool)  # a run starts here
    cut[first[:-1]] = True
    cut[0] = cut[-1] = True
    cut[:-1] |= stop
    cut[1:] |= stop
    at = np.flatnonzero(cut)
    size = np.diff(at)
    keep = (size >= tests.least) & ~stop[at[:-1]]
    pos, which = K.spread(at[:-1][keep], at[1:][keep])
    if not len(pos):
        return n_words, first, none, none, none, longest
    put = np.arange(len(pos)) + which  # a 0 stands between runs
    t, place = np.zeros(put[-1] + 2, np.int64), np.zeros(put[-1] + 2, np.int64)
    t[put], place[put] = w[pos], pos
    q, at, end_at, length = matches(tests, t)
    start = place[at]
    np.maximum.at(longest, np.searchsorted(first, place[end_at], "right") - 1, length)
    cover = np.zeros(len(w) + 1, np.int64)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + tests.window[q], -1)
    doc = np.searchsorted(first, start, "right") - 1
    pairs = np.unique(np.stack([doc, tests.item[q]], 1), axis=0) if len(q) else np.empty((0, 2), np.int64)
    return n_words, first, np.flatnonzero(np.cumsum(cover[:-1]) > 0), pairs[:, 0], pairs[:, 1], longest


SCHEMA = "n_words long, hits array<long>, n_hit long, n_items long, items array<string>, items_sha256 string, longest long, contaminated boolean"


def scan(tests: Tests, blocks: bool):
    """A mapInArrow function that adds the columns of SCHEMA to whole rows; hits are kept only if blocks are to be merged."""

    def run(batches):
        for b in batches:
            for row, data, offs in slices(b, "text"):
                n_words, first, hit, doc, item, longest = shard(tests, data, offs)
                n = len(n_words)
                doc_of = np.searchsorted(first, hit, "right") - 1
                n_hit = np.bincount(doc_of, minlength=n)
                items: list = [[] for _ in range(n)]
                for d, i in zip(doc.tolist(), item.tolist(), strict=True):
                    items[d].append(tests.ids[i])
                items = [sorted({str(x) for x in xs}) for xs in items]
                local = hit - first[doc_of]
                at = np.concatenate([[0], np.cumsum(n_hit)])
                cols = [pa.array(n_words, pa.int64()), pa.array([local[at[i] : at[i + 1]] for i in range(n)] if blocks else [None] * n, pa.list_(pa.int64())), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]), pa.array(longest), pa.array(n_hit > 0)]
                yield pa.RecordBatch.from_arrays(b.slice(row, n).columns + cols, names=b.schema.names + [f"_{i}" for i in range(len(cols))])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id") -> DataFrame:
    """docs with n_words, n_hit, n_items, items, items_sha256, longest (verbatim match, in words) and contaminated.

    Null texts have no words. An item under `window` words is one window; one without words is none. Items that share an id count
    once; a null item_id is written as "None". Repeated document rows each get their own, equal result. Columns of docs that clash
    with the added ones are replaced. An empty benchmark leaves every document clean.
    """
    spark = docs.sparkSession
    added = [x.split()[0] for x in SCHEMA.split(", ")]
    base = docs.drop(*added)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).filter("text <> ''")
    sized = items.agg(F.sum(F.octet_length("text") + 64).alias("n")).first()["n"] or 0
    blocks = max(1, -(-2 * sized // block_bytes)) if sized > block_bytes else 1
    if blocks == 1:
        rows = items.collect()  # at most block_bytes
        return run_block(base, rows, window, False).drop("hits")
    parts = items.withColumn("_b", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    keyed = base.withColumn("_h", text_hash())
    out = None
    for b in range(blocks):
        got = run_block(keyed.select(id_col, "text", "_h"), parts.filter(F.col("_b") == b).collect(), window, True).drop("text").dropDuplicates([id_col, "_h"])
        out = got if out is None else out.unionByName(got)
    merged = out.groupBy(id_col, "_h").agg(F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("longest").alias("longest"))
    merged = merged.select(F.col(id_col).alias("_id"), F.col("_h").alias("_k"), "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "longest", (F.size("hits") > 0).alias("contaminated"))
    return keyed.join(merged, keyed[id_col].eqNullSafe(merged["_id"]) & (keyed["_h"] == merged["_k"]), "left").drop("_id", "_k", "_h")


def run_block(docs: DataFrame, rows: list, window: int, blocks: bool) -> DataFrame:
    tests = Tests([r["item_id"] for r in rows], [r["text"] for r in rows], window)
    K._POWERS.clear()  # else it goes out with every task
    schema = StructType(docs.schema.fields + StructType.fromDDL(SCHEMA).fields)
    return docs.mapInArrow(scan(tests, blocks), schema)


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k
       FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, n, i FROM dw JOIN bw USING (n, k)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
x AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN x USING (doc_id)
"""
