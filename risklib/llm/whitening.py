"""Operator 13: whitening of embeddings, eigenvectors by mixed-precision refinement.

Entries become whole numbers x = floor(64 c) + 1000000. The fit list holds each
distinct vector once. Two passes over it give the sums S and, about the
rounded mean m, the Gram matrix of y = x - m. Both are sums of
whole numbers, added in 64-bit integers (or as doubles while every sum is below 2**53), so the covariance
V = (n G - s s') / n**2 with s = S - n m does not depend on how rows were
dealt to tasks. Only d x d numbers reach the driver; tasks add up their
share, and the shares are added by matrix row.

Eigenvectors: ``eigh`` in float32, then Ogita-Aishima iterations in extended
precision: with R = I - X'X, T = X'VX and l_i = t_ii / (1 - r_ii), the
correction is E_ij = (t_ij + l_j r_ij) / (l_j - l_i), or r_ij / 2 where two
eigenvalues are closer than the error of T, and X <- X + X E. A cluster of such
eigenvalues is solved on its own: the small matrix of V on the cluster's columns,
less its mean eigenvalue, is diagonalised in double precision and the
columns are turned by its eigenvectors, which makes them part in the next
iterations. Iterations end when the off-diagonal of T no longer shrinks.

Cases: null vectors and vectors with a null or non-finite entry are dropped,
and so are those with an entry beyond ``LARGEST`` (its x would not be a sound
long) and those whose length is not the most frequent one (ties: the longer).
A component without variance (fewer distinct vectors than dimensions) has
explained 0 and a null whitened value, and takes no part in identity_error.
deviation is null where it exceeds a long. Null and repeated vec_ids are
kept row by row; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risklib.llm.common import stored

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
LARGEST = float(1 << 40)
EXACT = float(1 << 53)
ITERATIONS = 40
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def refine(v: np.ndarray, x: np.ndarray, iterations: int = ITERATIONS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and eigenvectors of the symmetric ``v`` from approximate ones ``x``, in extended precision."""
    a = np.asarray(v, np.longdouble)
    x = np.asarray(x, np.longdouble)
    d = len(a)
    norm = float(np.sqrt((a * a).sum()))
    if not d or norm == 0:
        return np.zeros(d, np.longdouble), np.eye(d, dtype=np.longdouble)
    eye = np.eye(d, dtype=np.longdouble)
    tiny = float(np.finfo(np.longdouble).eps) * d
    best = np.inf
    turned = False
    for _ in range(iterations):
        r = eye - x.T @ x
        t = x.T @ (a @ x)
        t = (t + t.T) / 2  # else rounding, over a small gap, would undo orthogonality
        low = np.diag(t) / (1 - np.diag(r))
        off = t - np.diag(np.diag(t))
        error = float(np.sqrt((off * off).sum())) / norm + float(np.sqrt((r * r).sum()))
        if not turned and error < 4 * tiny:
            break
        if not turned and best < 1e-12 and error >= best / 2:  # no longer shrinking
            break
        best = min(best, error)
        delta = 2 * (float(np.sqrt(((t - np.diag(low)) ** 2).sum())) + norm * float(np.sqrt((r * r).sum())))
        gap = low[None, :] - low[:, None]
        close = np.abs(gap) <= delta
        e = np.where(close, r / 2, (t + low[None, :] * r) / np.where(close, 1, gap))
        x = x + x @ e
        turned = False
        for members in clusters(np.asarray(low, np.float64), delta):
            q = x[:, members]
            mean = low[members].mean()
            small = q.T @ (a @ q - mean * q)
            small = (small + small.T) / 2
            size = float(np.abs(small).max())
            rest = small - np.diag(np.diag(small))
            if float(np.abs(rest).max()) > 64 * tiny * norm:
                _, turn = np.linalg.eigh(np.asarray(small / size, np.float64))
                x[:, members] = q @ np.asarray(turn, np.longdouble)
                turned = True
    for _ in range(2):  # the last correction's square
        x = x + x @ (eye - x.T @ x) / 2
    x = x / np.sqrt((x * x).sum(axis=0))
    low = (x * (a @ x)).sum(axis=0)
    order = np.argsort(-low, kind="stable")
    return low[order], x[:, order]


def clusters(values: np.ndarray, delta: float) -> list[np.ndarray]:
    """Index sets of values that are linked by gaps of at most ``delta``; single ones are left out."""
    order = np.argsort(values, kind="stable")
    cut = np.flatnonzero(np.diff(values[order]) > delta) + 1
    return [c for c in np.split(order, cut) if len(c) > 1]


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors of a covariance, to double precision, from float32 ones."""
    size = float(np.abs(v).max()) if v.size else 0.0
    if size == 0:
        return np.zeros(len(v)), np.eye(len(v))
    scaled = np.asarray(v, np.longdouble) / np.longdouble(size)
    _, start = np.linalg.eigh(scaled.astype(np.float32))
    low, x = refine(scaled, start[:, ::-1])
    return np.asarray(low * np.longdouble(size), np.float64), np.asarray(x, np.float64)


def _entries(column: pa.Array, dim: int | None = None):
    """Places of the valid vectors in a list column and their x - SHIFT, [vectors, dim]; of any length where dim is None."""
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    ok = sizes >= 0 if dim is None else sizes == dim
    flat = column.flatten().cast(pa.float64())
    c = np.asarray(flat.fill_null(np.nan))
    bad = ~(np.abs(c) * SCALE < LARGEST)  # not-a-number and infinite entries too
    owner = np.repeat(np.arange(len(sizes)), np.maximum(sizes, 0))
    ok &= np.bincount(owner[bad], minlength=len(sizes)) == 0
    return np.flatnonzero(ok), np.floor(c[ok[owner]] * SCALE).astype(np.int64), sizes[ok]


def dimension(vectors: DataFrame, column: str = "embedding") -> int | None:
    """The most frequent length of the valid vectors; None without any."""
    def run(batches):
        for b in batches:
            _, _, sizes = _entries(b.column(0))
            found, counts = np.unique(sizes, return_counts=True)
            yield pa.record_batch({"dim": pa.array(found, pa.int64()), "c": pa.array(counts, pa.int64())})
    top = vectors.select(F.col(column).cast("array<double>")).mapInArrow(run, "dim long, c long").groupBy("dim").agg(
        F.sum("c").alias("c")).orderBy(F.desc("c"), F.desc("dim")).first()
    return top["dim"] if top and top["dim"] else None


def fit_list(vectors: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """Each distinct vector once, x - SHIFT as bytes of little-endian longs (``x``)."""
    def run(batches):
        for b in batches:
            _, x, _ = _entries(b.column(0), dim)
            data = x.astype("<i8").tobytes()
            step = 8 * dim
            yield pa.record_batch({"x": pa.array([data[i:i + step] for i in range(0, len(data), step)], pa.binary())})
    rows = vectors.select(F.col(column).cast("array<double>")).mapInArrow(run, "x binary")
    return stored(rows.distinct(), "whitening-fit")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, dim)


def sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """n and the exact sums of x - SHIFT."""
    def run(batches):
        n, total = 0, np.zeros(dim, object)
        for b in batches:
            x = _matrix(b.column(0), dim)
            n += len(x)
            total = total + x.sum(axis=0).astype(object)  # entries below 2**40, batches of some thousand rows
        yield pa.record_batch({"n": pa.array([n], pa.int64()), "s": pa.array([[str(t) for t in total]], pa.list_(pa.string()))})
    shares = fit.mapInArrow(run, "n long, s array<string>")
    parts = shares.select("n", F.posexplode("s").alias("i", "s")).groupBy("i").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # one row per dimension
    got = {r["i"]: r for r in parts}
    return (int(got[0]["n"]), [int(got[i]["s"]) for i in range(dim)]) if got else (0, [0] * dim)


def gram(rows: DataFrame, dim: int, values) -> np.ndarray:
    """Sum of y y' over all rows, y = values(batch) [rows, dim]; shares of the tasks are added by matrix row.

    Whole-number y below 2**53 in every sum add up exactly, in any order.
    """
    def share(batches):
        total = np.zeros((dim, dim))
        for b in batches:
            y = values(b)
            total += y.T @ y
        yield pa.record_batch({"i": pa.array(np.arange(dim), pa.int64()), "row": pa.array(list(total), pa.list_(pa.float64()))})

    def add(key, table):
        total = np.asarray(table.column("row").combine_chunks().flatten()).reshape(-1, dim)
        order = np.lexsort(total.T[::-1])  # shares come in any order; sum them in one
        return pa.table({"i": [key[0].as_py()], "row": pa.array([total[order].sum(axis=0)], pa.list_(pa.float64()))})

    found = rows.mapInArrow(share, "i long, row array<double>").groupBy("i").applyInArrow(add, "i long, row array<double>").collect()
    out = np.zeros((dim, dim))
    for r in found:  # dim rows
        out[r["i"]] = r["row"]
    return out


def fit_whitening(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> dict | None:
    """The fitted whitening: dim, n, exact sums, eigenvalues, eigenvectors and the measured identity error."""
    dim = dimension(vectors, column)
    if dim is None:
        return None
    fit = fit_list(vectors, dim, column)
    n, total = sums(fit, dim)
    middle = np.array([(2 * s + n) // (2 * n) for s in total], np.int64)  # the rounded mean of x - SHIFT
    g = gram(fit, dim, lambda b: (_matrix(b.column(0), dim) - middle).astype(np.float64))
    rest = [s - n * int(m) for s, m in zip(total, middle)]
    if np.abs(g).max() < EXACT:  # the entries are whole and exact
        v = np.array([[(n * int(g[i, j]) - rest[i] * rest[j]) / n ** 2 for j in range(dim)] for i in range(dim)])
    else:
        shift = np.array(rest, np.longdouble) / n
        v = np.asarray(np.asarray(g, np.longdouble) / n - np.outer(shift, shift), np.float64)
    low, x = eigen(v)
    k = min(components, dim)
    trace = float(np.trace(v))
    usable = low[:k] > max(trace, 0) * dim * 1e-15
    project = np.where(usable[:, None], x[:, :k].T / np.sqrt(np.where(usable, low[:k], 1))[:, None], 0.0)
    offset = np.array([r / n for r in rest])
    z = gram(fit, k, lambda b: ((_matrix(b.column(0), dim) - middle) - offset) @ project.T) / n  # about the exact mean 0
    error = float(np.abs(z - np.eye(k))[np.ix_(usable, usable)].max()) if usable.any() else 0.0
    return {"dim": dim, "n": n, "sums": [s + n * SHIFT for s in total], "middle": middle, "rest": rest, "offset": offset,
            "values": low, "vectors": x, "project": project, "usable": usable, "covariance": v,
            "explained": np.maximum(low[:k], 0) / trace if trace > 0 else np.zeros(k), "identity_error": error}


def whiten(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every valid row and component."""
    model = fit_whitening(vectors, column, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], RESULT)
    dim, n, k = model["dim"], model["n"], len(model["project"])
    middle, offset, project, usable = (model[c] for c in ("middle", "offset", "project", "usable"))
    rest, explained, error = np.array(model["rest"], object), model["explained"], model["identity_error"]

    def run(batches):
        for b in batches:
            at, x, _ = _entries(b.column(1), dim)
            y = x.reshape(-1, dim) - middle
            z = (y - offset) @ project.T
            about = (np.abs(y).astype(np.float64) + 1) * n  # bounds |n x - S|
            wide = (about * about).sum(axis=1) >= 2.0 ** 62
            if wide.any():
                deviation = [None if d >= 1 << 63 else d for d in (int(((n * row - rest) ** 2).sum()) for row in y.astype(object))]
            else:
                off = n * y - rest.astype(np.int64)
                deviation = (off * off).sum(axis=1)
            rows = len(y)
            ids = b.column(0).take(pa.array(at, pa.int64()))
            yield pa.record_batch({
                "vec_id": ids.take(pa.array(np.repeat(np.arange(rows), k), pa.int64())),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                "n": pa.array(np.full(rows * k, n, np.int64)),
                "deviation": pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(rows), k), pa.int64())),
                "whitened": pa.array(z.ravel(), mask=np.tile(~usable, rows)),
                "explained": pa.array(np.tile(explained, rows)),
                "identity_error": pa.array(np.full(rows * k, error))})

    return vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v")).mapInArrow(run, RESULT)
