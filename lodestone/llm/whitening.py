"""Whitening of embeddings by QDWH spectral divide-and-conquer.

Spark adds up the count, sums and centred products of the distinct vectors; what comes to the driver is one d x d matrix, whatever the number
of rows. There the polar factor of the covariance less a shift (QDWH: Halley iterations with weights from a bound of the least singular
value, by QR first and by Cholesky once that is well conditioned) is the sign of each eigenvalue's distance from the shift, so half its sum
with the identity projects on the subspace above the shift. Bases of that subspace and of the rest split the matrix in two smaller ones, which
are split in turn until single components are left (Nakatsukasa and Higham). Only parts that can hold one of the first k components are
split. The k components then go to all tasks: at most k x d numbers.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import durable, ships, table
from lodestone.llm.vectors import dimension, whole_numbers

ships(__name__)

TOP = 4
#: Dimensions up to which the d x d matrix is taken to the driver (128 MB).
MOST_DIMENSIONS = 4096
EPS = np.finfo(float).eps


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric, nonsingular matrix, by QDWH."""
    n, eye = len(a), np.eye(len(a))
    x = a / np.linalg.norm(a)
    try:
        low = 1 / np.linalg.norm(np.linalg.inv(x), 1)  # not above the least singular value
    except np.linalg.LinAlgError:
        low = EPS
    low = min(1.0, max(low, EPS))
    for _ in range(60):
        step = np.cbrt(4 * (1 - low**2) / low**4)
        root = np.sqrt(1 + step)
        u = root + np.sqrt(max(0.0, 8 - 4 * step + 8 * (2 - low**2) / (low**2 * root))) / 2
        v = (u - 1) ** 2 / 4
        w = u + v - 1
        if w > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(w) * x, eye]))
            new = v / w * x + (u - v / w) / np.sqrt(w) * (q[:n] @ q[n:].T)
        else:
            lower = np.linalg.cholesky(eye + w * (x.T @ x))
            new = v / w * x + (u - v / w) * np.linalg.solve(lower.T, np.linalg.solve(lower, x.T)).T
        new = (new + new.T) / 2
        low = min(1.0, low * (u + v * low**2) / (1 + w * low**2))
        moved = np.linalg.norm(new - x)
        x = new
        if moved <= np.cbrt(4 * EPS) and 1 - low < 10 * EPS:
            break
    return x


def split(a: np.ndarray) -> tuple[np.ndarray, int] | None:
    """An orthogonal basis whose first columns span what lies above a shift, and their number; None if all eigenvalues agree."""
    n, mean = len(a), np.trace(a) / len(a)
    spread = np.linalg.norm(a - mean * np.eye(n)) / np.sqrt(n)
    if spread <= 4 * EPS * np.linalg.norm(a):
        return None
    best = None
    for shift in (np.median(np.diag(a)), mean, mean + spread / 3, mean - spread / 3):
        above = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
        rank = int(round(np.trace(above)))
        if not 0 < rank < n:
            continue
        order = np.argsort(-np.einsum("ij,ij->j", above, above), kind="stable")  # heavy columns first, so that the first ones span the range
        q, _ = np.linalg.qr(above[:, order])
        for _ in range(2):  # subspace iteration: columns that were nearly dependent find their place
            q[:, :rank], _ = np.linalg.qr(above @ q[:, :rank])
        rest, _ = np.linalg.qr(np.hstack([q[:, :rank], q[:, rank:] - above @ q[:, rank:]]))
        q = np.hstack([q[:, :rank], rest[:, rank:]])
        error = np.linalg.norm(q[:, :rank].T @ a @ q[:, rank:]) / np.linalg.norm(a)
        if best is None or error < best[0]:
            best = error, q, rank
        if error <= 100 * n * EPS:
            break
    return None if best is None else best[1:]


def components(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns. Each eigenvector's largest entry
    is positive."""
    out: list[tuple[float, np.ndarray]] = []

    def conquer(basis: np.ndarray, part: np.ndarray) -> None:
        if len(out) >= k:
            return
        if len(part) == 1:
            out.append((float(part[0, 0]), basis[:, 0]))
            return
        halves = split(part)
        if halves is None:  # one eigenvalue: any basis will do
            out.extend((float(part[i, i]), basis[:, i]) for i in range(len(part)))
            return
        q, rank = halves
        for side in (q[:, :rank], q[:, rank:]):
            conquer(basis @ side, (m := side.T @ part @ side) / 2 + m.T / 2)

    if len(a):
        conquer(np.eye(len(a)), (a + a.T) / 2)
    values, vectors = np.array([e for e, _ in out]), np.array([v for _, v in out]).T.reshape(len(a), len(out))
    order = np.argsort(-values, kind="stable")[:k]
    values, vectors = values[order], vectors[:, order]
    if vectors.size:
        vectors = vectors / np.linalg.norm(vectors, axis=0)
        vectors *= np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1, 1)
        values = np.einsum("ij,ik,kj->j", vectors, a, vectors)
    return values, vectors


def encoded(id_col: str, vec_col: str, d: int):
    """A mapInArrow function: ids, and vectors as whole numbers of 8 bytes each."""

    def run(batches):
        for b in batches:
            x, at = whole_numbers(b, vec_col, d)
            yield pa.RecordBatch.from_arrays([b.column(id_col).take(pa.array(at)), pa.array([r.tobytes() for r in x.astype("<i8")], pa.binary())], names=[id_col, "x"])

    return run


def matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("x").to_pylist()), "<i8").reshape(-1, d)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return x - sums / n


def added(fit: DataFrame, make, width: int, whole: bool = False) -> np.ndarray:
    """The sum of the matrices that make(batch) gives, over all batches: each task adds up its own, whose rows are then added up by row number.

    Whole numbers are added up as decimals, so nothing overflows. What comes to the driver is one matrix."""
    kind = "decimal(38,0)" if whole else "double"

    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                m = make(b)
                total = m if total is None else total + m
        if total is not None:
            flat = pa.array([int(v) for v in total.ravel()]).cast(pa.decimal128(38, 0)) if whole else pa.array(total.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), flat], names=["i", "v"])

    rows = fit.select("x").mapInArrow(run, f"i long, v {kind}").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)") if whole else "v").alias("v")).collect()
    out = np.zeros(width, object if whole else float)
    for r in rows:
        out[r["i"]] = int(r["v"]) if whole else r["v"]
    return out


def whiten(df: DataFrame, k: int = TOP, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error): a row for each vector and each of its first k components.

    Vectors x = floor(256 c) of n distinct vectors have sums S and covariance V (divisor n). Components are eigenvectors of V by falling
    eigenvalue e; whitened is x - S/n on the component over sqrt(e), explained e over V's trace, deviation the sum of (n x - S)^2 (null
    beyond a long), identity_error the largest entry of whitened's covariance over the distinct vectors, less the identity.

    Left out are null and empty vectors, vectors with null, NaN or infinite entries, and vectors of another length than the most
    frequent one (ties: the longest). Entries beyond a long's range are cut to it. Rows that repeat, ids that repeat and null ids each give rows of
    their own. A component without variance (an eigenvalue within rounding of 0: one distinct vector, say) can't be whitened: its rows have null
    whitened, and explained null if V is zero. Other columns are dropped. An empty table gives no rows. More than 4096 dimensions raise.
    """
    spark, d = df.sparkSession, dimension(df, vec_col)
    if d > MOST_DIMENSIONS:
        raise ValueError(f"{d} dimensions; the covariance goes to the driver up to {MOST_DIMENSIONS}")
    ids = dict(df.dtypes)[id_col]
    out = f"{id_col} {ids}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = df.select(id_col, vec_col).mapInArrow(encoded(id_col, vec_col, d), f"{id_col} {ids}, x binary")
    fit = durable(rows.select("x").distinct())
    # int64 per batch is safe while entries stay below 2^40; beyond, Python's integers
    big = lambda x: x.astype(object) if x.size and np.abs(x.astype(float)).max() >= 1 << 40 else x
    total = added(fit, lambda b: np.concatenate([[b.num_rows], big(matrix(b, d)).sum(axis=0)]).astype(object), d + 1, whole=True)
    n, exact = int(total[0]), [int(s) for s in total[1:]]
    if not n:
        return spark.createDataFrame([], out)
    sums = np.array([float(s) for s in exact])
    square = lambda m: m.T @ m
    cov = added(fit, lambda b: square(centred(matrix(b, d), n, sums)), d * d).reshape(d, d) / n
    values, vectors = components((cov + cov.T) / 2, min(k, d))
    trace = float(np.trace(cov))
    flat = values <= d * EPS * max(trace, 0.0)  # nothing to whiten
    weights = vectors[:, ~flat] / np.sqrt(values[~flat])
    m = weights.shape[1]
    project = lambda b: centred(matrix(b, d), n, sums) @ weights
    moments = added(fit, lambda b: np.concatenate([(w := project(b)).sum(axis=0), square(w).ravel()]), m + m * m)
    mean, second = moments[:m] / n, moments[m:].reshape(m, m) / n
    error = float(np.abs(second - np.outer(mean, mean) - np.eye(m)).max()) if m else None
    bound = max(map(abs, exact), default=0)
    each = len(values)
    explained = [float(v) / trace if trace > 0 else None for v in values]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b, d)
            rough = ((n * x.astype(float) - sums) ** 2).sum(axis=1)
            sure = (rough < 1 << 62) & (np.abs(x).max(axis=1).astype(float) * n < 1 << 62) & (bound < 1 << 62)
            dev = np.zeros(len(x), np.int64)
            if sure.any():
                z = n * x[sure] - np.array(exact, np.int64)
                dev[sure] = (z * z).sum(axis=1)
            for i in np.flatnonzero(~sure):  # near or beyond the range of a long
                v = sum((n * int(c) - s) ** 2 for c, s in zip(x[i], exact, strict=True))
                sure[i] = v < 1 << 63
                dev[i] = v if sure[i] else 0
            w = np.full((len(x), each), np.nan)
            w[:, ~flat] = project(b)
            rep = pa.array(np.repeat(np.arange(len(x)), each))
            count = len(x) * each
            yield pa.RecordBatch.from_arrays([b.column(id_col).take(rep), pa.array(np.tile(np.arange(1, each + 1, dtype=np.int32), len(x))), pa.array(np.full(count, n)), pa.array(dev, mask=~sure).take(rep), pa.array(w.ravel(), mask=np.tile(flat, len(x))), pa.array(explained * len(x), pa.float64()), pa.array([error] * count, pa.float64())], names=[c.split()[0] for c in out.split(", ")])

    return rows.mapInArrow(run, out)


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
