"""Secret scans with multipart credential linking.

One pass over each text finds the base kinds (assign, access, hex) and the weak parts: user names and key ids (`ident`), high-entropy
strings (`token`) and service addresses (`endpoint`). A weak part alone says nothing. Within a scope (one document, and at most `reach` code
points between them) an interval join over the parts of all documents looks for its complement: a base secret or token beside an identifier or
endpoint. Only weak parts with a complement are reported. The join orders the parts of a document and compares each with the nearest
on either side, so it never builds pairs.
"""

import hashlib
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from lodestone.llm.common import durable, ships, table, text_hash

ships(__name__)

# The base kinds as they are asked for.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
# Weak parts, each of a role: who signs in, with what, and where.
IDENT = re.compile(r"""\b(?:user(?:name)?|login|client_id|account|access_key_id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})""", re.A | re.I)
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9a-z+/_-]*[A-Z])(?=[0-9A-Z+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}", re.A)
ENDPOINT = re.compile(r"\b(?:https?|ftp|ssh|amqps?|redis|mongodb|mysql|postgres(?:ql)?|jdbc:[a-z]+)://[A-Za-z0-9._:@%/-]+", re.A)
ORDER = ("assign", "access", "hex", "ident", "token", "endpoint")
REACH = 300

FOUND = "n_assign long, n_access long, n_hex long, base_sha256 string, _parts array<struct<kind:int,start:int,end:int>>"


def parts_of(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by start and then kind."""
    found = [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    taken: list[list[int]] = []  # what base kinds hold, as disjoint stretches in order
    for a, b in sorted((a, b) for _, a, b in found):
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    starts = [a for a, _ in taken]
    free = lambda a, b: not (k := bisect_right(starts, b - 1)) or taken[k - 1][1] <= a
    if any(c in text for c in "=:"):
        found += [(3, m.start(), m.end()) for m in IDENT.finditer(text)]
    if "://" in text:
        found += [(5, m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    if any(k in (1, 3, 5) for k, _, _ in found):  # a token without a complement in its text is never reported
        weak = [(4, m.start(), m.end()) for m in TOKEN.finditer(text)]
        found += [x for x in weak if free(x[1], x[2])]
    return sorted(found, key=lambda x: (x[1], x[0], x[2]))


def written(parts) -> str:
    return ",".join(f"{ORDER[k]}:{a}:{b}" for k, a, b in parts)


def scan(batches):
    for b in batches:
        rows = [parts_of(t.as_py() or "") for t in b.column("text")]
        counts = [[sum(p[0] == k for p in r) for r in rows] for k in range(3)]
        digests = [hashlib.sha256(written(p for p in r if p[0] < 3).encode()).hexdigest() for r in rows]
        parts = pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in r] for r in rows], pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])))
        cols = {c: b.column(c) for c in b.schema.names if c != "text"}
        cols |= {f"n_{k}": pa.array(n, pa.int64()) for k, n in zip(ORDER, counts, strict=False)} | {"base_sha256": pa.array(digests), "_parts": parts}
        yield pa.RecordBatch.from_pydict(cols)


def find_secrets(docs: DataFrame, reach: int = REACH, id_col: str = "doc_id") -> DataFrame:
    """One row for each row of docs: id_col, n_assign, n_access, n_hex, base_sha256, spans (all, as a string) and parts (as structs).

    Null texts are empty. Rows that repeat an id are told apart by a hash of their text; equal rows have equal results. Offsets are
    code points, end exclusive. Ties go by start, kind as listed, end.
    """
    keyed = docs.select(F.col(id_col).alias("_id"), text_hash().alias("_h"), F.col("text"))
    found = durable(keyed.mapInArrow(scan, StructType(keyed.drop("text").schema.fields + StructType.fromDDL(FOUND).fields)))  # texts are scanned once
    # base secrets and tokens complement identifiers and endpoints; an access identifier needs no company but gives it
    part = found.filter(F.exists("_parts", lambda p: p["kind"] > 2)).dropDuplicates(["_id", "_h"]).select("_id", "_h", F.explode("_parts").alias("p"))
    secret, other = F.col("p.kind").isin(0, 2, 4), F.col("p.kind").isin(1, 3, 5)
    # nearest end before and nearest start after, for either role
    before = Window.partitionBy("_id", "_h").orderBy("p.start", "p.kind", "p.end").rowsBetween(Window.unboundedPreceding, -1)
    # the reversed order, as a frame that starts at a row would be added up anew for each row
    after = Window.partitionBy("_id", "_h").orderBy(F.desc("p.start"), F.desc("p.kind"), F.desc("p.end")).rowsBetween(Window.unboundedPreceding, -1)
    near = lambda role: F.coalesce(F.col("p.start") - F.max(F.when(role, F.col("p.end"))).over(before) <= reach, F.lit(False)) | F.coalesce(F.min(F.when(role, F.col("p.start"))).over(after) - F.col("p.end") <= reach, F.lit(False))
    linked = part.select("_id", "_h", "p", F.when(secret, near(other)).otherwise(near(secret)).alias("_near")).filter((F.col("p.kind") > 2) & F.col("_near"))
    linked = linked.groupBy("_id", "_h").agg(F.collect_list("p").alias("_linked"))
    linked = linked.select(F.col("_id").alias("_id2"), F.col("_h").alias("_h2"), "_linked")
    names = F.array(*map(F.lit, ORDER))
    both = found.join(linked, found["_id"].eqNullSafe(linked["_id2"]) & (found["_h"] == linked["_h2"]), "left")
    base = F.filter("_parts", lambda p: p["kind"] <= 2)
    rows = F.when(F.col("_linked").isNull(), F.transform(base, lambda p: F.struct(p["start"].alias("start"), p["kind"].alias("kind"), p["end"].alias("end")))).otherwise(F.array_sort(F.transform(F.concat(base, "_linked"), lambda p: F.struct(p["start"].alias("start"), p["kind"].alias("kind"), p["end"].alias("end")))))
    both = both.withColumn("parts", F.transform(rows, lambda p: F.struct(F.get(names, p["kind"]).alias("kind"), p["start"].alias("start"), p["end"].alias("end"))))
    spans = F.array_join(F.transform("parts", lambda p: F.concat_ws(":", p["kind"], p["start"].cast("string"), p["end"].cast("string"))), ",")
    return both.select(F.col("_id").alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"), "parts")


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents")).drop("parts")
