"""Embedding whitening by blockwise QR, Householder bidiagonalisation, dqds and twisted factorisations.

Rows are scaled to whole numbers, so that sums are exact. Every block of rows is centred on its own
mean and folded into a triangular factor by QR; two factors merge by the QR of both with one more
row for the difference of their means, which is again the factor of the centred rows of both. One
scan gives n, the exact sums and R, in a tree of merges; R has a fixed size and is all that the
driver sees. There R is brought to bidiagonal form, dqds finds the squares of its singular values
to high relative accuracy, and a twisted factorisation at each gives its right singular vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, ready, store

SCALE, SHIFT = 1024.0, 100_000
#: Scaled entries are held within this bound, so that sums of a block are exact.
LIMIT = 2**32
COMPONENTS = 8
#: Factors that one merge takes.
FAN = 16
#: Rows that one QR takes.
ROWS = 2048
#: Eigenvalues nearer than this, relatively, get their vectors together.
CLUSTER = 1e-5
EPS = np.finfo(float).eps
STATE = "dim int, part long, n long, sums array<string>, r binary"


def scaled(column: pa.ChunkedArray | pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(row numbers, whole-number rows)`` of the valid vectors in a list column, by dimension.

    Vectors that are null, empty or hold null or non-finite entries are left out.
    """
    col = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.asarray(col.value_lengths().fill_null(0), np.int64)
    flat = np.asarray(col.flatten().cast(pa.float64()).fill_null(np.nan))
    at = np.cumsum(size) - size
    for dim in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == dim)
        x = flat[at[rows][:, None] + np.arange(dim)]
        good = np.isfinite(x).all(axis=1)
        if good.any():
            x = np.floor(SCALE * x[good]) + SHIFT
            yield rows[good], np.clip(x, -LIMIT, LIMIT).astype(np.int64)


@dataclass
class Factor:
    """Rows folded so far: their number, exact sums, and R with R'R = the sum of squares about the mean."""

    n: int
    sums: list[int]
    r: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Factor:
        n, sums = len(x), x.sum(axis=0)
        return cls(n, sums.tolist(), np.linalg.qr((n * x - sums) / n, mode="r"))

    def merge(self, other: Factor) -> Factor:
        gap = np.array([(b * self.n - a * other.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums)])
        n = self.n + other.n
        rows = np.vstack([self.r, other.r, math.sqrt(self.n / n * other.n) * gap])
        return Factor(n, [a + b for a, b in zip(self.sums, other.sums)], np.linalg.qr(rows, mode="r"))

    def row(self, part: int) -> dict:
        return {"dim": len(self.sums), "part": part, "n": self.n, "sums": list(map(str, self.sums)), "r": self.r.astype("<f8").tobytes()}

    @classmethod
    def read(cls, row) -> Factor:
        sums = list(map(int, row["sums"]))
        return cls(int(row["n"]), sums, np.frombuffer(bytes(row["r"]), "<f8").reshape(-1, len(sums)))


def factor(vectors: DataFrame, vector_col: str = "embedding") -> Factor | None:
    """The factor of all valid vectors of the commonest dimension (the smaller of equals); None without any."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        have: dict[int, Factor] = {}
        for batch in batches:
            for _, x in scaled(batch.column(0)):
                for lo in range(0, len(x), ROWS):
                    new, old = Factor.of(x[lo : lo + ROWS]), have.get(x.shape[1])
                    have[x.shape[1]] = new if old is None else old.merge(new)
        rows = [f.row(TaskContext.get().partitionId()) for f in have.values()]
        schema = pa.schema([("dim", pa.int32()), ("part", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("r", pa.binary())])
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("part").to_dict("records")
        whole = Factor.read(rows[0])
        for r in rows[1:]:
            whole = whole.merge(Factor.read(r))
        return pd.DataFrame([whole.row(rows[0]["part"] // FAN)])

    parts = store(vectors.select(F.col(vector_col).cast("array<double>")).mapInArrow(fold, STATE))
    while (last := parts.agg(F.max("part")).first()[0]) is not None and last > 0:
        step = F.floor(F.col("part") / FAN).cast("long")
        merged = store(parts.groupBy("dim", step.alias("step")).applyInPandas(join, STATE))
        drop(parts)
        parts = merged
    best = parts.orderBy(F.desc("n"), "dim").limit(1).collect()
    drop(parts)
    return Factor.read(best[0]) if best else None


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(a, b, v)``: diagonal and superdiagonal of B = U'RV, and V, by Householder reflections."""
    d = r.shape[1]
    m, v = np.zeros((d, d)), np.eye(d)
    m[: min(len(r), d)] = r[:d]
    for k in range(d):
        if (h := _reflector(m[k:, k])) is not None:
            m[k:, k:] -= 2 * np.outer(h, h @ m[k:, k:])
        if k < d - 2 and (h := _reflector(m[k, k + 1 :])) is not None:
            m[k:, k + 1 :] -= 2 * np.outer(m[k:, k + 1 :] @ h, h)
            v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ h, h)
    return np.diag(m).copy(), np.diag(m, 1).copy(), v


def _reflector(x: np.ndarray) -> np.ndarray | None:
    """The unit vector h for which (I - 2hh')x is a multiple of the first axis."""
    size = np.linalg.norm(x)
    if size == 0:
        return None
    h = x.copy()
    h[0] += math.copysign(size, x[0])
    return h / np.linalg.norm(h)


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of the bidiagonal matrix (a, b), largest first.

    Differential quotient-difference steps with shifts: a shift that would pass the smallest value
    is cut and the step repeated, so every step keeps all quantities positive.
    """
    out, todo = [], [((a * a).tolist(), (b * b).tolist(), 0.0)]
    while todo:
        q, e, sigma = todo.pop()
        if len(q) == 1:
            out.append(q[0] + sigma)
            continue
        tiny = [i for i, x in enumerate(e) if x <= EPS * EPS * (q[i] + q[i + 1] + sigma)]
        if tiny:
            i = tiny[-1]
            todo += [(q[: i + 1], e[:i], sigma), (q[i + 1 :], e[i + 1 :], sigma)]
            continue
        if q[0] < q[-1]:  # dqds sends small values to the end; the turned matrix has the same ones
            q, e = _turned(q, e)
        # Trailing 2 x 2 of B B': its smaller value is near the smallest of all.
        x, y, z = q[-2] + e[-1], q[-1], math.sqrt(q[-1] * e[-1])
        half = (x + y) / 2
        shift = max(0.0, (x * y - z * z) / (half + math.sqrt(max(0.0, half * half - (x * y - z * z))))) if half > 0 else 0.0
        for _ in range(4):
            if (step := _dqds_step(q, e, shift)) is not None:
                break
            shift *= 0.25
        else:
            shift, step = 0.0, _dqds_step(q, e, 0.0)
        todo.append((*step, sigma + shift))
    return np.sort(np.array(out))[::-1]


def _turned(q: list[float], e: list[float]) -> tuple[list[float], list[float]]:
    """The bidiagonal matrix of the reversed rows and columns, transposed: same singular values."""
    return q[::-1], e[::-1]


def _dqds_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One step; None where the shift passes the smallest value."""
    d, p, f = q[0] - shift, [], []
    for i, x in enumerate(e):
        if d < 0:
            return None
        p.append(d + x)
        t = q[i + 1] / p[-1]
        f.append(x * t)
        d = d * t - shift
    return None if d < 0 else ([*p, d], f)


def twisted(a: np.ndarray, b: np.ndarray, value: float) -> tuple[np.ndarray, float]:
    """A unit eigenvector of B'B for ``value`` and the value refined by its Rayleigh quotient."""
    d, l = a * a, b / a[:-1]
    n, tiny = len(a), np.finfo(float).tiny
    for _ in range(4):
        s, p, low, up = np.empty(n), np.empty(n), np.empty(n - 1), np.empty(n - 1)
        s[0] = -value
        for i in range(n - 1):  # from the top: L D L' - value
            low[i] = d[i] * l[i] / (s[i] + d[i] or tiny)
            s[i + 1] = low[i] * l[i] * s[i] - value
        p[-1] = d[-1] - value
        for i in range(n - 2, -1, -1):  # from the bottom: U D U'
            t = d[i] / (d[i] * l[i] * l[i] + p[i + 1] or tiny)
            up[i] = l[i] * t
            p[i] = p[i + 1] * t - value
        gamma = s + p + value
        k = int(np.argmin(np.abs(gamma)))
        z = np.zeros(n)
        z[k] = 1
        for i in range(k - 1, -1, -1):
            z[i] = -low[i] * z[i + 1]
        for i in range(k, n - 1):
            z[i + 1] = -up[i] * z[i]
        size = float(z @ z)
        value += gamma[k] / size
        if abs(gamma[k]) <= 2 * EPS * value * math.sqrt(size):
            break
    return z / math.sqrt(size), value


def directions(r: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """``(values, vectors, trace)`` of R'R: the ``k`` largest eigenvalues, unit columns, and the sum of all.

    Values that are zero to working precision are left out. Vectors of values within ``CLUSTER`` of
    each other come from inverse iteration on their common space.
    """
    a, b, v = bidiagonalise(r)
    values = dqds(a, b)
    trace, keep = float(values.sum()), values > values[:1] * EPS * len(values)
    values = values[keep & (values > 0)]
    a = np.where(np.abs(a) < EPS * math.sqrt(trace), EPS * math.sqrt(trace), a)
    groups: list[list[int]] = []
    for i, x in enumerate(values):
        if groups and values[i - 1] - x <= CLUSTER * values[i - 1]:
            groups[-1].append(i)
        elif i >= k:
            break
        else:
            groups.append([i])
    cols = []
    for g in groups:
        if len(g) == 1:
            z, values[g[0]] = twisted(a, b, values[g[0]])
            cols.append(z[:, None])
        else:
            cols.append(_together(a, b, values, g))
    z = np.hstack(cols)[:, :k] if cols else np.zeros((len(a), 0))
    return values[: z.shape[1]], v @ z, trace


def _together(a: np.ndarray, b: np.ndarray, values: np.ndarray, group: list[int]) -> np.ndarray:
    """Orthonormal vectors of a cluster of values: inverse iteration on all, then the small problem inside."""
    m = np.diag(a) + np.diag(b, 1)
    t = m.T @ m
    y = np.random.default_rng(0).standard_normal((len(a), len(group)))
    at = values[group].mean() + 4 * EPS * values[0]
    for _ in range(4):
        y = np.linalg.qr(np.linalg.solve(t - at * np.eye(len(a)), y))[0]
    w, inner = np.linalg.eigh(y.T @ t @ y)
    values[group] = w[::-1]
    return y @ inner[:, ::-1]


@dataclass
class Model:
    """A fitted whitening: rows and exact sums of the fit list, eigenvalues of the covariance and their vectors."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def fit(vectors: DataFrame, vector_col: str = "embedding", k: int = COMPONENTS) -> Model | None:
    """Whitening fitted on every valid vector; None where there is none."""
    ready(vectors.sparkSession)
    f = factor(vectors, vector_col)
    if f is None:
        return None
    values, columns, trace = directions(f.r, k)
    return Model(f.n, f.sums, values / f.n, columns, trace / f.n)


def whiten(vectors: DataFrame, model: Model, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, deviation, whitened array<double>)`` of every valid vector of the model's dimension.

    deviation is the exact sum of squares of n * x - S, null where it passes the range of a long.
    """
    n, dim = model.n, len(model.sums)
    weight = model.vectors / np.sqrt(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = n * LIMIT * 2 < 2**62
        sums = np.array(model.sums, np.int64 if exact else object)
        for batch in batches:
            for rows, x in scaled(batch.column(1)):
                if x.shape[1] != dim:
                    continue
                y = n * (x if exact else x.astype(object)) - sums
                w = (y / n).astype(np.float64) @ weight
                about = np.square(y.astype(np.float64)).sum(axis=1)
                deviation = [None] * len(y)
                if exact:
                    for i in np.flatnonzero(about < 9e18):
                        deviation[i] = int(y[i] @ y[i])
                for i in np.flatnonzero((about < 9.3e18) & ((about >= 9e18) | (not exact))):
                    whole = sum(int(c) ** 2 for c in y[i])
                    deviation[i] = whole if whole < 2**63 else None
                ids = batch.column(0).take(pa.array(rows))
                flat = pa.array(w.ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), flat)
                yield pa.RecordBatch.from_arrays([ids, pa.array(deviation, pa.int64()), lists], names=["vec_id", "deviation", "whitened"])

    slim = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return slim.mapInArrow(run, f"vec_id {dict(slim.dtypes)['vec_id']}, deviation long, whitened array<double>")


def covariance_error(whitened: DataFrame, k: int) -> float:
    """Largest entry of the covariance of a column of ``k`` whitened values minus the identity, centred before multiplying."""
    w = [F.col("whitened")[i] for i in range(k)]
    row = whitened.agg(*[F.covar_pop(w[i], w[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i + 1)]).first()
    return max(abs(row[f"c{i}_{j}"] - (i == j)) for i in range(k) for j in range(i + 1))


def components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` for each valid vector and component.

    Vectors that are null, empty, or hold null or non-finite entries are dropped and are not fitted
    on, as are those of another dimension than the commonest. Components without variance have no
    rows: a table of equal vectors, or an empty one, gives an empty result. Null and repeated ids
    keep their rows; other columns are not read.
    """
    spark = ready(vectors.sparkSession)
    model = fit(vectors, vector_col, k)
    id_type = vectors.select(id_col).dtypes[0][1]
    if model is None or not len(model.values):
        return spark.createDataFrame([], f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    found = store(whiten(vectors, model, id_col, vector_col))
    error = covariance_error(found, len(model.values))
    share = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    rows = found.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(share, F.col("at") + 1).alias("explained"), F.lit(float(error)).alias("identity_error"),
    )
