"""Exact removal of repeated byte strings by a column-wise suffix order over many documents.

The collection's order of suffixes, with common prefix lengths, is built one column of symbols a round for all strings at once: the
order by the suffixes from column c + 1 becomes the one from column c by a stable distribution on the symbols in c, and the common prefix of
two neighbours is one more than the least between them before (the multi-document construction of Bauer, Cox and Rosone). A round over
the whole corpus would be a pass over all of it for each of 100 symbols, so the rounds run on what can hold a repeat, in shards:

1. Every window of 100 bytes names an anchor: the leftmost least hash of its 69 substrings of 32 bytes. Equal windows name equal anchors at
   the same place in them. About one byte in 35 is an anchor; one shuffle by anchor hash leaves those that occur twice. Where all that an
   anchor's windows cover is equal too (by a second 64-bit hash), all but the earliest are settled there.
2. The bytes that an anchor's windows cover are cut from the texts, laid with the anchor in the same column, and dealt to shards by
   anchor hash. All copies of a window lie in one shard, so shards need no merge. Each shard runs the rounds; neighbours with common
   prefixes of 100 and more are equal windows, and all but the earliest count as removed.
3. The removed spans go back to their documents.

Hot groups: copies of the same stretch within a slice of documents are settled where they are read, and only the earliest goes on;
anchors that still have more than `hot` places are dealt by the hash of each single window instead, with partial aggregation.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import kernels as K
from lodestone.llm.common import dealt, durable, running, ships, slices, table, text_hash

ships(__name__)

LENGTH, GRAM = 100, 32
REACH = LENGTH - GRAM  # how far before its anchor a window can start
SHARD_STRINGS, HOT = 50_000, 20_000


def unique_ids(docs: DataFrame, id_col: str) -> tuple[DataFrame, bool]:
    """docs with _uid, in the order of ids (null last, then a hash of the text), and whether it differs from the id.

    Rows of equal id and text share a _uid. Only where ids are repeated or null are they numbered anew.
    """
    odd = docs.groupBy(id_col).count().filter(F.col(id_col).isNull() | (F.col("count") > 1))
    if odd.isEmpty():
        return docs.withColumn("_uid", F.col(id_col).cast("long")), False
    order = ["_null", "_id", "_h"]
    ids = docs.select(F.col(id_col).isNull().alias("_null"), F.col(id_col).alias("_id"), text_hash().alias("_h")).distinct().withColumn("_all", F.lit(0))
    ids = running(dealt(ids, ["_all"], order), ["_all"], order, {"_uid": F.lit(1)}).select("_id", F.col("_h").alias("_h2"), "_uid")
    keyed = docs.withColumn("_h", text_hash())
    return keyed.join(ids, keyed[id_col].eqNullSafe(ids["_id"]) & (keyed["_h"] == ids["_h2"])).drop("_id", "_h", "_h2"), True


def anchors(data: np.ndarray, offs: np.ndarray):
    """(hash, anchor, first window, last window, hash of what the windows cover) of every anchor of a slice's documents, in places of the slice."""
    n = len(data)
    if n < LENGTH:
        return (np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 3, np.empty(0, np.uint64))
    p, inv = K.prefixes(data), K.powers(K.R_INV, n)
    h = K.mixed((p[GRAM:] - p[:-GRAM]) * inv[: n - GRAM + 1])
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width, least = 1, key
    while 2 * width <= REACH + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = REACH + 1 - width
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)  # of the window at each place
    starts, ends = offs[:-1], offs[1:] - LENGTH + 1
    ok = ends > starts
    w, doc = K.spread(starts[ok], ends[ok])
    a = anchor[w]
    new = np.ones(len(w), bool)
    new[1:] = (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:], [len(w)]]) - 1
    lo, hi = w[at], w[last]
    # a hash of hashes: a polynomial of the bytes themselves has known collisions modulo 2 ** 64
    q = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * K.powers(K.R, len(h)), out=q[1:])
    return h[a[at]], a[at], lo, hi, K.mixed((q[hi + LENGTH - GRAM + 1] - q[lo]) * inv[lo])


def anchor_pieces(data: np.ndarray, offs: np.ndarray):
    """anchors() of a slice; of a very long document in pieces of about K.PIECE windows. The anchor of a window depends on the window alone."""
    if len(data) <= K.PIECE or len(offs) > 2:
        yield anchors(data, offs)
        return
    for at in range(0, len(data) - LENGTH + 1, K.PIECE):
        part = data[at : at + K.PIECE + LENGTH - 1]
        h, a, lo, hi, cover = anchors(part, np.array([0, len(part)]))
        yield h, a + at, lo + at, hi + at, cover


def packed(a, lo, hi):
    return (a << 16) | ((a - lo) << 8) | (a - hi)


def unpacked(x):
    a = x >> 16
    return a, a - ((x >> 8) & 255), a - (x & 255)


def anchor_rows(batches):
    """(h, cover, _uid, at, settled): anchors; settled ones have an equal, earlier stretch in the same slice and a random h."""
    for b in batches:
        uid = b.column("_uid").to_numpy()
        for row, data, offs in slices(b, "text"):
            for h, a, lo, hi, cover in anchor_pieces(data, offs):
                doc = np.searchsorted(offs, lo, "right") - 1
                base = offs[doc]
                u, at = uid[row + doc], packed(a - base, lo - base, hi - base)
                order = np.lexsort((at, u, at & 0xFFFF, cover, h))
                h, u, at, cover = h[order], u[order], at[order], cover[order]
                settled = np.zeros(len(h), bool)
                settled[1:] = (h[1:] == h[:-1]) & (cover[1:] == cover[:-1]) & ((at[1:] & 0xFFFF) == (at[:-1] & 0xFFFF))
                h = np.where(settled, K.mixed(u.astype(np.uint64) * np.uint64(K.R) + at.astype(np.uint64)), h)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(cover.view(np.int64)), pa.array(u), pa.array(at), pa.array(settled)], names=["h", "cover", "_uid", "at", "settled"])


def repeated(batches):
    """Of rows sorted by (h, cover, _uid, at): all but the first of each (h, cover) as settled, the first if its h has other covers
    too, and the rows settled before."""
    names = ["h", "_uid", "at", "settled"]
    last, before = None, (None, None)
    for b in batches:
        if not b.num_rows:
            continue
        h, cover = b.column("h").to_numpy(), b.column("cover").to_numpy()
        copy = np.zeros(len(h), bool)
        copy[1:] = (h[1:] == h[:-1]) & (cover[1:] == cover[:-1])
        copy[0] = before == (h[0], cover[0])
        before = (h[-1], cover[-1])
        b = b.select(names)
        if copy.any():
            done = b.filter(pa.array(copy))
            yield pa.RecordBatch.from_arrays([*done.columns[:3], pa.array(np.ones(done.num_rows, bool))], names=names)
            b = b.filter(pa.array(~copy))
        if last is not None:
            b = pa.Table.from_batches([last, b]).combine_chunks().to_batches()[0]
        h, settled = b.column("h").to_numpy(), b.column("settled").to_numpy(zero_copy_only=False)
        if len(h) < 2:
            last = b
            continue
        same = np.zeros(len(h), bool)
        same[1:] = h[1:] == h[:-1]
        same[:-1] |= same[1:]
        # the last row waits for the next batch, with the one before it if they are equal (it has been given out already)
        keep = same | settled
        if last is not None and last.num_rows == 2:
            keep[0] = False
        keep[-1] = False
        yield b.filter(pa.array(keep))
        last = b.slice(len(h) - 2, 2) if h[-1] == h[-2] else b.slice(len(h) - 1, 1)
    if last is not None and (last.num_rows == 2 or last.column("settled")[-1].as_py()):
        yield last.slice(last.num_rows - 1, 1)


def stretches(batches):
    """(h, _uid, at, cover): the bytes that the windows of each anchor cover."""
    for b in batches:
        for row in range(b.num_rows):
            text = b.column("text")[row].as_py().encode()
            h, at = (np.array(b.column(c)[row].as_py(), np.int64) for c in ("hs", "ats"))
            _, lo, hi = unpacked(at)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), b.column("_uid")[row].as_py(), np.int64)), pa.array(at), pa.array([text[i : j + LENGTH] for i, j in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary())], names=["h", "_uid", "at", "cover"])


def later_windows(text: np.ndarray, first: np.ndarray, last: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each string (a row of text) and column, whether the window there also stands in a string of lower rank, at the same column.

    first, last: each string's first and last window. The rounds of the column-wise construction, from the last column to column 0.
    """
    n, width = text.shape
    out = np.zeros((n, REACH + 1), bool)
    order, common = np.arange(n), np.zeros(n, np.uint8)
    for c in range(width - 1, -1, -1):
        symbol = text[order, c]
        moved = np.argsort(symbol, kind="stable")
        new, sym = order[moved], symbol[moved]
        # least common prefix between the places that neighbours had, from a table of minima over powers of two
        tables = [common]
        while 2 << (len(tables) - 1) <= n:
            t, w = tables[-1], 1 << (len(tables) - 1)
            tables.append(np.minimum(t[:-w], t[w:]))
        fresh = np.zeros(n, np.uint8)
        pair = np.flatnonzero(sym[1:] == sym[:-1])
        lo, hi = moved[pair] + 1, moved[pair + 1]
        level = np.frexp(hi - lo + 1)[1] - 1
        least = np.empty(len(pair), np.uint8)
        for k in np.unique(level).tolist():
            m = level == k
            least[m] = np.minimum(tables[k][lo[m]], tables[k][hi[m] - (1 << k) + 1])
        fresh[pair + 1] = np.minimum(least, 254) + 1
        order, common = new, fresh
        if c > REACH:
            continue
        live = (first[order] <= c) & (c <= last[order])
        run = np.cumsum(common < LENGTH)
        who, run = order[live], run[live]
        if not len(who):
            continue
        start = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        low = np.minimum.reduceat(rank[who], start)
        out[who, c] = rank[who] > np.repeat(low, np.diff(np.concatenate([start, [len(who)]])))
    return out


def shard_spans(batches):
    """(_uid, start, end): spans of a shard's strings that repeat an earlier one."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    t = pa.Table.from_batches(parts).combine_chunks()
    uid, at, cover = t.column("_uid").to_numpy(), t.column("at").to_numpy(), t.column("cover").combine_chunks()
    cover = cover.chunk(0) if isinstance(cover, pa.ChunkedArray) else cover
    a, lo, hi = unpacked(at)
    _, offs, data = cover.cast(pa.large_binary()).buffers()
    offs, data = np.frombuffer(offs, np.int64)[cover.offset : cover.offset + len(cover) + 1], np.frombuffer(data, np.uint8)
    first, last = REACH - (a - lo), REACH - (a - hi)  # columns, the anchor at REACH
    text = np.zeros((len(uid), REACH + LENGTH), np.uint8)
    src, which = K.spread(offs[:-1], offs[1:])
    text[which, src - offs[which] + first[which]] = data[src]
    rank = np.empty(len(uid), np.int64)
    rank[np.lexsort((a, uid))] = np.arange(len(uid))
    hit = later_windows(text, first, last, rank)
    edge = np.zeros((len(uid), REACH + 3), np.int8)
    edge[:, 1:-1] = hit
    step = np.diff(edge, axis=1)
    s, e = np.nonzero(step == 1), np.nonzero(step == -1)
    base = lo[s[0]] - first[s[0]]
    yield pa.RecordBatch.from_arrays([pa.array(uid[s[0]]), pa.array(base + s[1]), pa.array(base + e[1] - 1 + LENGTH)], names=["_uid", "start", "end"])


def single_windows(batches):
    """(w, _uid, start): every window of the hot anchors' strings, by a hash of its bytes."""
    for b in batches:
        out = []
        for uid, at, cover in zip(b.column("_uid").to_pylist(), b.column("at").to_numpy().tolist(), b.column("cover").to_pylist(), strict=True):
            _, lo, hi = unpacked(at)
            out += [(hashlib.blake2b(cover[i : i + LENGTH], digest_size=16).digest(), uid, lo + i) for i in range(hi - lo + 1)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())], names=["w", "_uid", "start"])


def kept_text(names: list[str], emit: bool):
    """A mapInArrow function: removed spans joined to maximal runs, and what is left."""

    def run(batches):
        for b in batches:
            texts = [(t.as_py() or "").encode() for t in b.column("text")]
            n_removed, n_spans, digests, kept, runs = [], [], [], [], []
            for text, spans in zip(texts, b.column("_spans").to_pylist(), strict=True):
                merged: list[list[int]] = []
                for x in sorted((x["start"], x["end"]) for x in spans or ()):
                    if merged and x[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x[1])
                    else:
                        merged.append([*x])
                at, left = 0, []
                for s, e in merged:
                    left.append(text[at:s])
                    at = e
                left = b"".join([*left, text[at:]])
                n_removed.append(len(text) - len(left))
                n_spans.append(len(merged))
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append(left if emit else None)
                runs.append([{"start": s, "end": e} for s, e in merged])
            cols = [*(b.column(c) for c in names), pa.array([len(t) for t in texts], pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests), pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    return run


def repeated_spans(docs: DataFrame, shard_strings: int = SHARD_STRINGS, hot: int = HOT) -> DataFrame:
    """(_uid, start, end) of docs (_uid, text; a _uid once): byte spans that are covered by windows with an earlier copy."""
    dealt_ = docs.mapInArrow(anchor_rows, "h long, cover long, _uid long, at long, settled boolean").repartition("h").sortWithinPartitions("h", "cover", "_uid", "at")
    found = durable(dealt_.mapInArrow(repeated, "h long, _uid long, at long, settled boolean"))
    place = F.shiftright("at", 16)
    done = found.filter("settled").select("_uid", (place - F.shiftright("at", 8).bitwiseAND(255)).alias("start"), (place - F.col("at").bitwiseAND(255) + LENGTH).alias("end"))
    open_ = found.filter("NOT settled")
    lists = open_.groupBy("_uid").agg(F.collect_list("h").alias("hs"), F.collect_list("at").alias("ats"))
    covers = docs.join(lists, "_uid").select("_uid", "text", "hs", "ats").mapInArrow(stretches, "h long, _uid long, at long, cover binary")
    n = open_.count()
    many = open_.groupBy("h").count().filter(F.col("count") > hot).select("h").limit(-(-n // hot) + 1)  # all of them: there can't be more
    many = durable(many)
    if many.isEmpty():
        few = covers
    else:
        covers = durable(covers)
        few = covers.join(F.broadcast(many), "h", "left_anti")  # one in `hot` anchors at most
        windows = covers.join(F.broadcast(many), "h", "left_semi").mapInArrow(single_windows, "w binary, _uid long, start long")
        windows = durable(windows)
        low = windows.groupBy("w").agg(F.min(F.struct("_uid", "start")).alias("low"))
        later = windows.join(low, "w").filter((F.col("_uid") != F.col("low._uid")) | (F.col("start") != F.col("low.start")))
        done = done.unionByName(later.select("_uid", "start", (F.col("start") + LENGTH).alias("end")))
    shards = max(1, -(-n // shard_strings))
    spans = few.repartition(shards, "h").mapInArrow(shard_spans, "_uid long, start long, end long")
    return spans.unionByName(done)


def dedup(docs: DataFrame, id_col: str = "doc_id", emit: bool = True, shard_strings: int = SHARD_STRINGS, hot: int = HOT) -> DataFrame:
    """One row for each row of docs: id_col, n_bytes, n_removed, n_spans, kept_sha256, spans (start, end in bytes) and kept (bytes; null
    unless emit).

    A byte goes if a 100-byte string over it also starts earlier: in a smaller id, or before in the same document. Null texts are
    empty. Rows that repeat an id are ordered by a hash of their text; rows of equal id and text are one document, and each gets its
    result. Null ids come last. Strings are judged on the input, and never cross documents.
    """
    rows, renamed = unique_ids(docs.select(id_col, "text"), id_col)
    if renamed:
        rows = durable(rows)
    spans = repeated_spans((rows.dropDuplicates(["_uid"]) if renamed else rows).select("_uid", "text"), shard_strings, hot)
    spans = spans.groupBy("_uid").agg(F.collect_list(F.struct("start", "end")).alias("_spans"))
    schema = f"{id_col} {rows.schema[id_col].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary"
    return rows.join(spans, "_uid", "left").select(id_col, "text", "_spans").mapInArrow(kept_text([id_col], emit), schema)


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"), emit=False).drop("spans", "kept")
