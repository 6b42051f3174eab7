"""MinHash near-duplicates by an inverted join over signature coordinates.

Each document's set of word shingles has a signature of 32 minima. A signature is posted under its coordinate-value pairs; pairs that one set
alone holds are dropped, the others are ordered by how many sets hold them. Two signatures with at least 14 coordinates in common share one
of their rarest posts: of s posts that are left, the first s - 13 are enough (the prefix), so widespread values (a passage that many
documents share) are merged for those documents only that have nothing rarer. Within a posting list the coordinates that two signatures share
are counted, and sets that are already joined are skipped: each list gives the links of a spanning forest, not its pairs. Lists beyond a block
are dealt as pairs of blocks. The groups so found hold every pair above the match threshold; in them the full sets are compared, again by
spanning forests, in blocks of bounded size in the order of set sizes.

Of two sets with similarity 0.8, 25.6 coordinates agree on average; that fewer than 14 do has a probability of about 2e-6, and then
the pair is lost only if no path of other links joins it.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import dealt, durable, running, ships, table, text_hash
from lodestone.llm.kernels import mixed, spread
from lodestone.llm.simhash import components

ships(__name__)

SHINGLE, COORDINATES, MATCHES, SEED = 2, 32, 14, 42
#: A link has 100 * intersection >= LEAST * union.
LEAST = 80
#: Sets of a posting list in one block; shingles in one block of full sets (a set alone may exceed it), and what a set weighs besides.
LIST_BLOCK, SET_BLOCK, SET_WEIGHT = 1024, 1 << 20, 64
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class Words(dict):
    """Hashes of words; a long-lived task forgets them when there are many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 19:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, SEED)
        return h


def shingles(text: str | None, known: Words, size: int = SHINGLE) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct shingles of the whole text; the whole sequence is one where there are fewer words."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED + 1)], np.uint64)
    h = np.fromiter((known[w] for w in words), np.uint64, len(words))
    n = len(h) - size + 1
    out = h[:n]
    for i in range(1, size):
        out = mixed(out) + h[i : i + n]
    return np.unique(mixed(out))


def multipliers(m: int) -> np.ndarray:
    return mixed(np.arange(1, m + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signature(hashes: np.ndarray, by: np.ndarray) -> np.ndarray:
    """For each multiplier, the upper half of the smallest product (mod 2^64) with a hash."""
    least = np.full(len(by), np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), 8192):
        np.minimum(least, np.multiply.outer(by, hashes[i : i + 8192]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def signed(docs: DataFrame, size: int, m: int) -> DataFrame:
    """(_id, _text) to (_id, n, digest, sig): set size, 128-bit digest of the set, signature; the last two null for documents without words."""

    def run(batches):
        known, by = Words(), multipliers(m)
        for b in batches:
            n, digests, sigs = [], [], []
            for t in b.column("_text"):
                h = shingles(t.as_py(), known, size)
                n.append(len(h))
                digests.append(xxhash.xxh128_digest(h.tobytes()) if len(h) else None)
                sigs.append(signature(h, by).tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_t"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], names=["_id", "_t", "n", "digest", "sig"])

    kind = dict(docs.dtypes)["_id"]
    return docs.select("_id", text_hash("_text").alias("_t"), "_text").mapInArrow(run, f"_id {kind}, _t long, n long, digest binary, sig binary")


def postings(sets: DataFrame, m: int) -> DataFrame:
    """(node, key): a row for each coordinate of each signature; a key holds the coordinate and its value."""

    def run(batches):
        tag = np.arange(m, dtype=np.int64) << 32
        for b in batches:
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), "<u4").reshape(-1, m)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("node").to_numpy(), m)), pa.array((sig.astype(np.int64) + tag).ravel())], names=["node", "key"])

    return sets.select("node", "sig").mapInArrow(run, "node long, key long")


def grouped(batches, keys: tuple[str, ...]):
    """The rows of batches sorted by keys, as one table for each run of equal keys."""
    held, now = [], None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy() for k in keys]
        new = np.flatnonzero(np.logical_or.reduce([np.diff(c) != 0 for c in cols])) + 1
        for i, j in zip([0, *new.tolist()], [*new.tolist(), b.num_rows], strict=True):
            key = tuple(int(c[i]) for c in cols)
            if key != now and held:
                yield pa.Table.from_batches(held)
                held = []
            now = key
            held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def alike(n: np.ndarray, of: int, least: int) -> np.ndarray:
    """Whether sets of these sizes can link with one of size `of`."""
    return 100 * np.minimum(n, of) >= least * np.maximum(n, of)


def forest(n: int, near) -> tuple[list, list]:
    """Links that join whatever near(i, left), which tells the places of `left` that i links with, joins. What is joined is not asked for again."""
    left, a, b = np.arange(n), [], []
    while len(left) > 1:
        open_, left = [int(left[0])], left[1:]
        while open_ and len(left):
            i = open_.pop()
            hit = near(i, left)
            found = left[hit]
            if len(found):
                a.append(np.full(len(found), i))
                b.append(found)
                open_.extend(found.tolist())
                rest = np.ones(len(left), bool)
                rest[hit] = False
                left = left[rest]
    return a, b


def linked(nodes: np.ndarray, a: list, b: list):
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(nodes[np.concatenate(a)]), pa.array(nodes[np.concatenate(b)])], names=["a", "b"])


def matching(m: int, matches: int, least: int):
    """A mapInArrow function over (key, cell, node, n, sig), sorted by key and cell: links of at least `matches` equal coordinates."""

    def run(batches):
        for t in grouped(batches, ("key", "cell")):
            if t.num_rows < 2:
                continue
            nodes, n = t.column("node").to_numpy(), t.column("n").to_numpy()
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u4").reshape(-1, m)
            yield from linked(nodes, *forest(len(nodes), lambda i, left: np.flatnonzero(((sig[left] == sig[i]).sum(axis=1) >= matches) & alike(n[left], n[i], least))))  # noqa: B023

    return run


def confirming(m: int, size: int, matches: int, least: int):
    """A mapInArrow function over (root, cell, node, digest, sig, _text), sorted by root and cell: links by the full sets."""

    def run(batches):
        known = Words()
        for t in grouped(hashed(batches, known), ("root", "cell")):
            nodes, first = np.unique(t.column("node").to_numpy(), return_index=True)  # rows that repeat an id and a text
            t = t.take(pa.array(first))
            sets = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
            if len(nodes) < 2:
                continue
            n = np.array([len(x) for x in sets])
            at = np.concatenate([[0], np.cumsum(n)])
            _, flat = np.unique(np.concatenate(sets), return_inverse=True)
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u4").reshape(-1, m)
            mark = np.zeros(int(flat.max()) + 1, np.int64)

            def near(i, left):
                places = np.flatnonzero(((sig[left] == sig[i]).sum(axis=1) >= matches) & alike(n[left], n[i], least))  # noqa: B023
                if not len(places):
                    return places
                of = left[places]
                mark[flat[at[i] : at[i + 1]]] = 1  # noqa: B023
                own, which = spread(at[of], at[of + 1])  # noqa: B023
                both = np.bincount(which, mark[flat[own]], len(of)).astype(np.int64)  # noqa: B023
                mark[flat[at[i] : at[i + 1]]] = 0  # noqa: B023
                return places[100 * both >= least * (n[i] + n[of] - both)]  # noqa: B023

            yield from linked(nodes, *forest(len(nodes), near))

    def hashed(batches, known):
        for b in batches:
            sets = [shingles(x.as_py(), known, size) for x in b.column("_text")]
            keep = [i for i, (s, d) in enumerate(zip(sets, b.column("digest"), strict=True)) if xxhash.xxh128_digest(s.tobytes()) == d.as_py()]
            cols = [b.column(c).take(pa.array(keep, pa.int64())) for c in ("root", "cell", "node", "sig")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([sets[i].tobytes() for i in keep], pa.large_binary())], names=["root", "cell", "node", "sig", "set"])

    return run


def candidates(sets: DataFrame, m: int, matches: int, least: int, list_block: int) -> DataFrame:
    """Links (a, b) of nodes that join every two whose signatures have at least `matches` coordinates in common. sets: (node, n, sig)."""
    posts = postings(sets, m)
    held = posts.groupBy("key").agg(F.count("*").alias("held")).filter("held > 1")
    each = posts.join(held, "key").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("held", "key"))).alias("p")).filter(F.size("p") >= matches)  # at most m
    prefix = each.select("node", F.explode(F.slice("p", F.lit(1), F.size("p") - (matches - 1))).alias("p"))
    # blocks of a list: a list of h sets has at most h in the prefixes
    blocks = F.ceil(F.col("p.held") / list_block).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    others = F.filter(F.sequence(F.lit(0), blocks - 1), lambda c: (c != own) | (blocks == 1))  # a cell of two blocks holds the pairs within each as well
    cells = F.transform(others, lambda c: F.least(c, own).cast("long") * (1 << 31) + F.greatest(c, own))
    dealt_ = prefix.select("node", F.col("p.key").alias("key"), F.explode(cells).alias("cell"))
    dealt_ = dealt_.join(sets.select("node", "n", "sig"), "node").select("key", "cell", "node", "n", "sig")
    return dealt_.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(matching(m, matches, least), "a long, b long")


def cells_of(members: DataFrame, least: int, set_block: int) -> DataFrame:
    """members (root, node, n, ..) with `cell`: groups are cut into blocks by set size; a row for each pair of blocks that can hold a link."""
    rows = running(dealt(members, ["root"], ["n", "node"]), ["root"], ["n", "node"], {"before": F.col("n") + SET_WEIGHT})
    rows = durable(rows.withColumn("block", F.floor(F.col("before") / set_block).cast("long")))
    blocks = rows.groupBy("root", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    a, b = blocks.select(F.col("root").alias("r"), F.col("block").alias("i"), F.col("high").alias("top")), blocks.select("root", F.col("block").alias("j"), "low")
    pairs = a.join(b, F.col("r") == F.col("root")).filter((F.col("i") <= F.col("j")) & ((F.col("i") == F.col("j")) | (100 * F.col("top") >= least * F.col("low"))))
    pairs = pairs.select("root", (F.col("i") * (1 << 31) + F.col("j")).alias("cell"), F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    return rows.join(pairs, ["root", "block"]).select("root", "cell", *[c for c in members.columns if c != "root"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, coordinates: int = COORDINATES, matches: int = MATCHES, least: int = LEAST, list_block: int = LIST_BLOCK, set_block: int = SET_BLOCK) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for each row of docs: the number of distinct word shingles, the smallest id reachable over links
    of similarity `least` hundredths or more (Jaccard, on full sets), and whether that is the row's own.

    Null texts and texts without words have an empty set and link with nothing: their component is their id. Texts with fewer words than a
    shingle have their whole sequence as one. Rows that repeat an id or a text each keep a row; an id with several texts reaches what each of
    them does, row by row. A null id is passed over by the minimum: a component of null ids alone has a null component_id, and rows
    with a null id aren't kept. Other columns are dropped. An empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = durable(signed(docs, size, coordinates).withColumn("row", F.monotonically_increasing_id()))
    known = rows.filter("digest IS NOT NULL")
    sets = known.groupBy("digest", "n", "sig").agg(F.min("row").alias("node"), F.min("_id").alias("low"), F.min_by(F.struct("_id", "_t"), "row").alias("of"))
    sets = durable(sets.select("node", "n", "digest", "sig", "low", F.col("of._id").alias("of_id"), F.col("of._t").alias("of_t")))
    groups = components(durable(candidates(sets, coordinates, matches, least, list_block)))
    members = groups.join(sets, "node").select("root", "node", "n", "digest", "sig", "of_id", "of_t")
    cells = durable(cells_of(members, least, set_block))
    texts = docs.withColumn("_t", text_hash("_text")).join(cells, F.col("_id").eqNullSafe(F.col("of_id")) & (F.col("_t") == F.col("of_t")))
    texts = texts.select("root", "cell", "node", "digest", "sig", "_text").repartition("root", "cell").sortWithinPartitions("root", "cell")
    edges = durable(texts.mapInArrow(confirming(coordinates, size, matches, least), "a long, b long"))
    found = sets.join(components(edges), "node", "left").select("digest", F.coalesce("root", "node").alias("root"), "low")
    lowest = found.groupBy("root").agg(F.min("low").alias("component_id"))
    of = found.join(lowest, "root").select("digest", "component_id")
    out = known.select("_id", "n", "digest").join(of, "digest").select("_id", "n", "component_id").unionByName(rows.filter("digest IS NULL").select("_id", "n", F.col("_id").alias("component_id")))
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op12_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w WHERE len(w) > 0),
k AS (SELECT s, row_number() OVER () AS k FROM (SELECT s FROM s GROUP BY s HAVING count(*) > 1)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT doc_id, k FROM s JOIN k USING (s)),
l AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM p x JOIN p y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY ALL) JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE 100 * shared >= 80 * (ca.n + cb.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS reached FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached)
SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, coalesce(m.low, d.doc_id) AS component_id, coalesce(m.low, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN (SELECT doc_id, min(reached) AS low FROM r GROUP BY doc_id) m USING (doc_id)
"""
