"""SimHash near-duplicates: fingerprints, pigeonring candidates, connected components.

A fingerprint has eight segments on a ring. If two differ in at most 3 bits, some segment starts a chain in which every prefix of
l segments differs in at most 3 l / 8 bits (the pigeonring principle): none in the first two, one in the first five, two in the
first seven. So two of the segments 3 to 5 agree as well as 1 and 2, and each fingerprint goes under 8 starts x 3 choices to
24 buckets of 32 equal bits. Pairs of a bucket must hold the chain's budgets before the full Hamming check, and a bucket gives only
the links of a spanning forest, not all pairs. A bucket beyond `most` is dealt anew by one more equal segment (of the other
four, one at least agrees); if it is still larger it is compared in blocks of bounded memory.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import durable, ships, table

ships(__name__)

BITS, SEGMENTS, SEED, SHINGLE = 3, 8, 42, 3
KINDS = 3 * SEGMENTS  # of buckets; view v has the kinds from v * KINDS on
MOST = 4096
#: Pairs of fingerprints that a bucket compares at once, and passing ones that are joined at once.
PAIRS, JOINED = 1 << 18, 1 << 12
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def remixed(h: np.ndarray, view: int) -> np.ndarray:
    """The hashes of another view: those of view 0, mixed with its number (the finishing steps of SplitMix64)."""
    if not view:
        return h
    h = h + np.uint64(view * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def fingerprint(text: str | None, shingle: int = SHINGLE, views: int = 1) -> list[int]:
    """For each view, the bits set in over half the hashes (XXH64; remixed beyond view 0) of the text's word shingles, repeats included; 0
    without words."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return [0] * views
    whole = b" ".join(words)
    if len(words) <= shingle:
        h = np.array([xxhash.xxh64_intdigest(whole, SEED)], np.uint64)
    else:
        end = np.cumsum([len(w) + 1 for w in words])
        at = [0, *end.tolist()]
        digest = xxhash.xxh64_intdigest
        h = np.fromiter((digest(whole[a : b - 1], SEED) for a, b in zip(at, at[shingle:])), np.uint64, len(words) - shingle + 1)  # noqa: B905
    set_ = np.zeros((views, 64), np.int64)
    for i in range(0, len(h), 1 << 16):  # a very long text isn't unpacked at once
        for v in range(views):
            set_[v] += np.unpackbits(remixed(h[i : i + (1 << 16)], v).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return np.packbits(2 * set_ > len(h), axis=1, bitorder="little").view("<u8")[:, 0].tolist()


def names(views: int) -> list[str]:
    return ["fp", *(f"fp{v}" for v in range(1, views))]


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE, views: int = 1) -> DataFrame:
    """docs with `fp`, the fingerprint as a signed long, and fp1, fp2, .. of further views; without the text."""
    made = names(views)
    keep = [c for c in docs.columns if c not in (text_col, *made)]

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle, views) for t in b.column(text_col)], np.uint64).reshape(-1, views).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(np.ascontiguousarray(fp[:, v])) for v in range(views))], names=[*keep, *made])

    return docs.select(*keep, text_col).mapInArrow(run, docs.select(*keep, *[F.lit(0).cast("long").alias(c) for c in made]).schema)


def chains() -> list[list[int]]:
    """The segments that must agree, a list for each bucket kind: two from the start, then two of the next three."""
    return [[(i + k) % SEGMENTS for k in (0, 1, *(x for x in (2, 3, 4) if x != wild))] for i in range(SEGMENTS) for wild in (2, 3, 4)]


def masks() -> np.ndarray:
    """For each kind, the bits that the chain's first 5 and first 7 segments hold."""
    at = lambda i, n: sum(0xFF << 8 * ((i + k) % SEGMENTS) for k in range(n))
    return np.array([[at(kind // 3, 5), at(kind // 3, 7)] for kind in range(3 * SEGMENTS)], np.uint64)


def segment(s: int):
    return F.shiftrightunsigned("fp", 8 * s).bitwiseAND(0xFF)


def forest(fp: np.ndarray, kind: int, bits: int) -> tuple[list[int], list[int]]:
    """Links that join all of a bucket's fingerprints which links of at most `bits` bits within it join. In blocks of rows; in a large group
    of near copies nearly all pairs pass, but most are joined already and don't become Python numbers."""
    root = np.arange(len(fp))
    left, right = [], []

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    near, far = masks()[kind]
    block = max(1, PAIRS // len(fp))
    for a in range(0, len(fp), block):
        x = fp[a : a + block, None] ^ fp[None, a:]
        i, j = np.nonzero(np.bitwise_count(x & near) <= bits * 5 // SEGMENTS)
        i, j = i[a + i < a + j], j[a + i < a + j]
        x = x[i, j]
        ok = np.bitwise_count(x & far) <= bits * 7 // SEGMENTS  # the chain's budget
        i, j, x = i[ok], j[ok], x[ok]
        ok = np.bitwise_count(x) <= bits
        i, j = a + i[ok], a + j[ok]
        for b in range(0, len(i), JOINED):
            x, y = i[b : b + JOINED], j[b : b + JOINED]
            if len(i) > JOINED:
                while not np.array_equal(root, at := root[root]):
                    root[:] = at
                new = root[x] != root[y]
                x, y = x[new], y[new]
            for u, v in zip(x.tolist(), y.tolist(), strict=True):
                p, q = top(u), top(v)
                if p != q:
                    root[max(p, q)] = min(p, q)
                    left.append(u)
                    right.append(v)
    return left, right


def bucket_links(bits: int, most: int | None):
    """A mapInArrow function over rows sorted by (kind, key): links within each bucket; members of buckets beyond `most` come back
    with b null, to be dealt anew."""

    def run(batches):
        held: tuple = (None, [])
        passing = False  # the bucket at hand is beyond `most`

        def close(key, parts):
            fp = np.concatenate(parts).view(np.uint64)
            if len(fp) < 2:
                return
            u, v = forest(fp, int(key[0]) % KINDS, bits)
            if u:
                fp = fp.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), key[0], np.int32)), pa.array(np.full(len(u), key[1], np.int64)), pa.array(fp[u]), pa.array(fp[v])], names=["kind", "key", "a", "b"])

        def passed(key, fp):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), key[0], np.int32)), pa.array(np.full(len(fp), key[1], np.int64)), pa.array(fp), pa.nulls(len(fp), pa.int64())], names=["kind", "key", "a", "b"])

        for batch in batches:
            kind, key, fp = (batch.column(c).to_numpy() for c in ("kind", "key", "fp"))
            if not len(fp):
                continue
            new = np.flatnonzero((np.diff(kind) != 0) | (np.diff(key) != 0)) + 1
            for a, b in zip([0, *new.tolist()], [*new.tolist(), len(fp)], strict=True):
                now = (int(kind[a]), int(key[a]))
                if now != held[0]:
                    if held[1]:
                        yield from close(*held)
                    held, passing = (now, []), False
                if passing:
                    yield passed(now, fp[a:b])
                    continue
                held[1].append(fp[a:b])
                if most and sum(map(len, held[1])) > most:
                    yield passed(now, np.concatenate(held[1]))
                    held, passing = (now, []), True
        if held[1]:
            yield from close(*held)

    return run


def links(fps: DataFrame, bits: int = BITS, most: int = MOST) -> DataFrame:
    """(view, a, b): pairs of distinct fingerprints `fp` that join every two of a view which a path of links of at most `bits` (0 to 3) bits joins.

    fps: (fp), or (view, fp) for several views, which are dealt and compared in one pass."""
    fps = fps if "view" in fps.columns else fps.withColumn("view", F.lit(0))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), sum((segment(s) * (1 << 8 * j) for j, s in enumerate(segs)), F.lit(0).cast("long")).alias("key")) for k, segs in enumerate(chains())])
    schema = "kind int, key long, a long, b long"
    dealt = lambda df: df.repartition("kind", "key").sortWithinPartitions("kind", "key").mapInArrow(bucket_links(bits, None), schema)
    first = fps.select("view", "fp", F.explode(kinds).alias("_k")).select((F.col("view") * KINDS + F.col("_k.kind")).cast("int").alias("kind"), "_k.key", "fp")
    first = durable(first.repartition("kind", "key").sortWithinPartitions("kind", "key").mapInArrow(bucket_links(bits, most), schema))
    beyond = first.filter("b IS NULL")
    view = F.floor(F.col("kind") / KINDS).cast("int").alias("view")
    out = first.filter("b IS NOT NULL").select(view, "a", "b")
    if not beyond.isEmpty():
        rest = F.when(F.lit(False), F.array(F.lit(0)))  # by kind, the four segments that the bucket doesn't hold equal
        for k, segs in enumerate(chains()):
            rest = rest.when(F.col("kind") % KINDS == k, F.array(*[F.lit(s) for s in range(SEGMENTS) if s not in segs]))
        again = beyond.select("kind", "key", F.col("a").alias("fp"), F.explode(rest).alias("_s"))
        again = again.select("kind", (F.col("key") * (1 << 11) + F.col("_s") * 256 + F.expr("shiftrightunsigned(fp, 8 * _s) & 255")).alias("key"), "fp")
        out = out.unionByName(dealt(again).select(view, "a", "b"))
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected edges (a, b); root is the component's smallest node.

    Large-star and small-star rounds (Kiveris et al.): each node's neighbours are hung on their smallest, so that the number of
    rounds grows with the logarithm of a component's size. Each round is cut by a checkpoint.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        new = small.checkpoint()
        if new.count() == e.count() and new.exceptAll(e).isEmpty():
            break
        e = new
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def viewed_links(fps: DataFrame, views: int, bits: int, most: int) -> DataFrame:
    """Pairs (a, b) of `fp` that join every two whose fingerprints of some view are equal or linked. fps: (fp, fp1, fp2, ..).

    In each view a fingerprint stands for the smallest `fp` that has it."""
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("view"), F.col(c).alias("of")) for v, c in enumerate(names(views))])).alias("x")
    pairs = fps.select("fp", each).select("fp", "x.view", "x.of").distinct()
    first = durable(pairs.groupBy("view", "of").agg(F.min("fp").alias("first")))
    equal = pairs.join(first, ["view", "of"]).filter("fp <> first").select(F.col("fp").alias("a"), F.col("first").alias("b"))
    end = lambda c: first.select("view", F.col("of").alias(c), F.col("first").alias(f"_{c}"))
    near = links(first.select("view", F.col("of").alias("fp")), bits, most)
    return equal.unionByName(near.join(end("a"), ["view", "a"]).join(end("b"), ["view", "b"]).select(F.col("_a").alias("a"), F.col("_b").alias("b")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, shingle: int = SHINGLE, most: int = MOST, keep: tuple[str, ...] = (), views: int = 1) -> DataFrame:
    """One row for each row of docs: id_col, fp (long), fingerprint (16 hex digits), component_id (smallest id reachable), root (the
    component's smallest fp; one id can stand in several components), and the columns in keep.

    Each of several views is a fingerprint of its own, and texts link if they do in any: a pair that one view misses by chance is met in
    another. fp, fingerprint and root are those of the first view.

    Null and empty texts have fingerprint 0 and link like any other. Repeated rows and ids each keep a row; a null id is passed over
    by the minimum, so a component of null ids alone has a null component_id. An empty table gives no rows.
    """
    fp = durable(fingerprints(docs.select(F.col(id_col).alias("_id"), *keep, F.col(text_col).alias("_text")), "_text", shingle, views))
    nodes = fp.groupBy("fp").agg(F.min("_id").alias("low"))
    edges = links(nodes.select("fp"), bits, most) if views == 1 else viewed_links(fp, views, bits, most)
    roots = components(edges).withColumnRenamed("node", "fp")
    of = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    low = of.groupBy("root").agg(F.min("low").alias("component_id"))
    of = of.select("fp", "root").join(low, "root").select(F.col("fp").alias("_fp"), "component_id", "root")
    return fp.join(of, fp["fp"] == of["_fp"]).select(F.col("_id").alias(id_col), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root", *keep)


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
