"""Whitening of embeddings: components by QDWH spectral divide-and-conquer, sent to all tasks to project every row.

Vectors become integers, so counts, sums and squared deviations are exact. The covariance of the distinct integer vectors is
summed over the table, each task's rows centred on the exact mean before they are multiplied; only matrices of a vector's
length squared leave the tasks. Its spectrum is then split again and again: the polar factor U of A - s I, found by
dynamically weighted Halley iterations in their QR form, gives the projector (I + U) / 2 on the eigenvectors whose
eigenvalues are above the shift s; orthonormal bases of its range and of the complement cut A into two smaller problems,
until each has one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import shuffle_partitions, staged
from marlstone.llm.vectors import matrix, small, usable

#: What entries are multiplied by before they are rounded down.
UNITS = 256
#: Rows that a task works on at once.
BATCH = 4096
EPS = np.finfo(np.float64).eps


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a square symmetric matrix by QDWH: each step maps singular values by a rational
    function whose weights follow a lower bound of the smallest of them; no inverse is formed."""
    n = len(a)
    size = np.linalg.norm(a, 2) * (1 + 8 * EPS)
    x = a / size
    low = max(np.linalg.svd(x, compute_uv=False)[-1] * 0.9, EPS)
    for _ in range(40):
        d = (4 * (1 - low**2) / low**4) ** (1 / 3)
        root = np.sqrt(1 + d)
        wide = root + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low**2) / (low**2 * root)))
        curve = (wide - 1) ** 2 / 4
        deep = wide + curve - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(deep) * x, np.eye(n)]))
        new = (curve / deep) * x + (wide - curve / deep) / np.sqrt(deep) * (q[:n] @ q[n:].T)
        moved = np.linalg.norm(new - x)
        x = (new + new.T) / 2
        low = min(1.0, low * (wide + curve * low**2) / (1 + deep * low**2))
        if moved <= 1e-10 * max(1.0, np.linalg.norm(x)) and abs(1 - low) < 1e-10:
            break
    return x


def _halves(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces of the eigenvalues above and below a shift; None where no shift parts
    them, as when all eigenvalues are equal to rounding."""
    n = len(a)
    size = np.linalg.norm(a)
    diagonal = np.sort(np.diag(a))
    middle = np.trace(a) / n
    spread = max(np.linalg.norm(a - middle * np.eye(n)), EPS * size)
    # Eigenvalues lie on both sides of their mean unless all are equal; other shifts serve where one of them meets the first.
    for shift in (np.median(diagonal), middle, middle + 1e-3 * spread, middle - 1e-3 * spread, middle + 1e-7 * spread, middle - 1e-7 * spread):
        moved = a - shift * np.eye(n)
        if np.linalg.svd(moved, compute_uv=False)[-1] <= 8 * EPS * size:
            continue
        projector = (polar(moved) + np.eye(n)) / 2
        rank = int(round(np.trace(projector)))
        if not 0 < rank < n:
            continue
        # A projector's columns of the greatest lengths, made orthonormal, span its range; two rounds make it so to rounding.
        order = np.argsort(-np.diag(projector), kind="stable")
        q, _ = np.linalg.qr(projector[:, order], mode="complete")
        basis = projector @ q[:, :rank]
        q, _ = np.linalg.qr(basis, mode="complete")
        upper, lower = q[:, :rank], q[:, rank:]
        if np.linalg.norm(lower.T @ a @ upper) <= 1e-12 * size:
            return upper, lower
    return None


def components_of(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns) of a symmetric matrix by spectral divide-and-conquer."""
    a = (a + a.T) / 2
    n = len(a)
    size = np.linalg.norm(a)
    if n == 1 or size == 0 or np.linalg.norm(a - np.diag(np.diag(a))) <= EPS * size:
        found = np.diag(a).copy(), np.eye(n)
    else:
        halves = _halves(a)
        if halves is None:  # equal to rounding: any basis
            found = np.diag(a).copy(), np.eye(n)
        else:
            parts = [(w, v @ y) for v in halves for w, y in [components_of(v.T @ a @ v)]]
            found = np.concatenate([w for w, _ in parts]), np.concatenate([v for _, v in parts], axis=1)
    order = np.argsort(-found[0], kind="stable")
    return found[0][order], found[1][:, order]


def sharpened(a: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs after a first-order correction by what is left off the diagonal, made orthonormal again."""
    b = vectors.T @ a @ vectors
    b = (b + b.T) / 2
    values = np.diag(b).copy()
    gap = values[None, :] - values[:, None]
    safe = np.abs(gap) > np.abs(b) * 1e3 + EPS * max(1e-300, np.abs(values).max(initial=0))
    turn = np.where(safe & ~np.eye(len(b), dtype=bool), b / np.where(safe, gap, 1), 0)
    q, r = np.linalg.qr(vectors + vectors @ turn)
    q = q * np.sign(np.where(np.diag(r) == 0, 1, np.diag(r)))
    values = ((a @ q) * q).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    return values[order], q[:, order]


def integers(column: str, dims: int) -> Column:
    """floor(256 c) of each entry as a long; shorter vectors end in zeros."""
    whole = F.transform(column, lambda c: F.floor(c.cast("double") * F.lit(float(UNITS))).cast("long") + F.lit(0).cast("long"))
    return F.when(F.size(column) >= dims, whole).otherwise(F.concat(whole, F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size(column))))


def _summed(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sum of the tasks' matrices, row by row of the matrix: first in tasks, then at most ``shape`` on the driver."""

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[at] = held.get(at, 0) + np.frombuffer(raw)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["at", "sums"])

    out = np.zeros(shape)
    # Ordered within their tasks, so that the rounding of the sums doesn't depend on which task ends first.
    for r in parts.repartition(min(shape[0], shuffle_partitions(parts.sparkSession)), "at").sortWithinPartitions("at", "sums").mapInArrow(add, "at int, sums binary").collect():
        out[r["at"]] += np.frombuffer(r["sums"])
    return out


def _rows_of(sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array([np.ascontiguousarray(r, dtype=np.float64).tobytes() for r in sums], pa.binary())], names=["at", "sums"])


def exact_deviation(x: np.ndarray, n: int, sums: np.ndarray) -> np.ma.MaskedArray:
    """Sum over dimensions of (n x - S)^2, exact; masked where it is beyond a long. ``sums`` holds whole numbers of Python."""
    most = n * max(int(np.abs(x.astype(np.float64)).max(initial=0)), 1) + max(map(abs, sums.tolist()), default=0)
    if most * most * max(1, x.shape[1]) < 2**63:
        gap = n * x - sums.astype(np.int64)
        return np.ma.array((gap * gap).sum(axis=1), mask=np.zeros(len(x), dtype=bool))
    found = [sum((n * v - s) ** 2 for v, s in zip(row, sums.tolist())) for row in x.tolist()]
    beyond = np.array([v >= 2**63 for v in found], dtype=bool)
    return np.ma.array(np.array([0 if b else v for v, b in zip(found, beyond)], dtype=np.int64), mask=beyond)


def whitened(vectors: DataFrame, components: int = 4, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each usable row and each of the first
    ``components`` components.

    Rows whose vector is null, empty or holds nulls or non-finite entries are dropped; shorter vectors end in zeros. Each
    entry is floor(256 c) as a long (the nearest long where it is beyond). Sums, covariance and components are
    those of the distinct vectors, each once, so repeated rows change nothing but are returned each. ``deviation`` is null
    where it is beyond a long. A component whose eigenvalue is zero to rounding, as when all vectors are equal, has no
    scale: its ``whitened`` is null, and ``identity_error`` leaves it out (0 if none is left). Ids may be null and may
    repeat. An empty table gives no rows; other columns are ignored, whatever their names. The driver holds matrices of a
    vector's length squared, never rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("vector")), "vector")
    dims = rows.agg(F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("dims")).first()["dims"]
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not dims:
        return spark.createDataFrame([], schema)
    rows = rows.select("vec_id", integers("vector", dims).alias("x"))
    distinct = staged(rows.select("x").distinct(), "whitening-fit")  # equal vectors of a task become one before the shuffle
    n = distinct.count()

    def total(batches):
        sums = [0] * dims
        for batch in small(batches, BATCH):
            x = matrix(batch.column(0), dims, np.int64)
            if len(x) and np.abs(x).max() > 2**40:
                part = [sum(c) for c in zip(*x.tolist())]
            else:
                part = x.sum(axis=0).tolist()
            sums = [a + b for a, b in zip(sums, part)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([str(v) for v in sums])], names=["at", "part"])

    parts = distinct.mapInArrow(total, "at int, part string").groupBy("at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("sums"))
    sums_of = {r["at"]: int(r["sums"]) for r in parts.collect()}  # one row for each dimension
    exact = np.array([sums_of[i] for i in range(dims)], dtype=object)
    mean = np.array([s / n for s in exact], dtype=np.float64)

    def centred_products(batches):
        held = np.zeros((dims, dims))
        for batch in small(batches, BATCH):
            gap = matrix(batch.column(0), dims, np.int64) - mean
            held += gap.T @ gap
        yield _rows_of(held)

    covariance = _summed(distinct.mapInArrow(centred_products, "at int, sums binary"), (dims, dims)) / n
    values, axes = sharpened(covariance, components_of(covariance)[1])
    count = min(components, dims)
    values, axes = values[:count], axes[:, :count]
    trace = float(np.trace(covariance))
    real = values > dims * EPS * trace * 16
    scale = np.where(real, 1 / np.sqrt(np.where(real, values, 1)), np.nan)

    def projected(x: np.ndarray) -> np.ndarray:
        return ((x - mean) @ axes) * scale

    def spread(batches):
        """Counts, sums and centred products of a task's whitened rows, batches merged as they come."""
        seen, middle, products = 0, np.zeros(count), np.zeros((count, count))
        for batch in small(batches, BATCH):
            w = projected(matrix(batch.column(0), dims, np.int64))
            if len(w):
                here = w.mean(axis=0)
                products += (w - here).T @ (w - here) + np.outer(here - middle, here - middle) * (seen * len(w) / (seen + len(w)))
                middle = middle + (here - middle) * (len(w) / (seen + len(w)))
                seen += len(w)
        yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([middle.tobytes()], pa.binary()), pa.array([products.tobytes()], pa.binary())], names=["seen", "middle", "products"])

    def merge(batches):
        seen, middle, products = 0, np.zeros(count), np.zeros((count, count))
        for batch in batches:
            for m, raw, p in zip(*(c.to_pylist() for c in batch.columns)):
                if m:
                    here = np.frombuffer(raw)
                    products = products + np.frombuffer(p).reshape(count, count) + np.outer(here - middle, here - middle) * (seen * m / (seen + m))
                    middle = middle + (here - middle) * (m / (seen + m))
                    seen += m
        yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([middle.tobytes()], pa.binary()), pa.array([products.tobytes()], pa.binary())], names=["seen", "middle", "products"])

    fields = "seen long, middle binary, products binary"
    merged = distinct.mapInArrow(spread, fields).coalesce(1).mapInArrow(merge, fields).first() if count else None  # a few numbers a task
    off = np.abs(np.frombuffer(merged["products"]).reshape(count, count) / n - np.eye(count))[np.ix_(real, real)]
    error = float(off.max(initial=0))
    explained = values / trace if trace > 0 else np.zeros(count)

    def project(batches):
        for batch in small(batches, BATCH):
            x = matrix(batch.column(1), dims, np.int64)
            m = len(x)
            found = exact_deviation(x, n, exact)
            w = projected(x)
            each = np.repeat(np.arange(m), count)
            which = np.tile(np.arange(count), m)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)), pa.array((which + 1).astype(np.int32)), pa.array(np.full(m * count, n, dtype=np.int64)), pa.array(found.data[each], mask=np.ma.getmaskarray(found)[each]),
                    pa.array(w.ravel(), mask=~np.tile(real, m)), pa.array(explained[which]), pa.array(np.full(m * count, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(project, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
