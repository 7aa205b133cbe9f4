"""Whitening of embeddings: eigenpairs of their covariance by contour integration (FEAST), checked by inertia counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavegrid.llm.common import map_arrow, materialize, slices

#: Points of the quadrature on the upper half of a contour.
POINTS = 8
#: Entries stop here, so that sums over batches stay whole numbers of 64 bits.
LARGEST = 1 << 40
EPS = float(np.finfo(float).eps)


def integer_vectors(rows: DataFrame, id_col: str, vector: str, scale: int = 256) -> DataFrame:
    """``vec_id, x``: floor(scale * c) of each entry. Rows without a vector, or with entries that are null or not finite, are left out."""
    v = F.col(f"`{vector}`")
    fine = v.isNotNull() & F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False)))
    whole = F.transform(v, lambda c: F.greatest(F.least(F.floor(c.cast("double") * scale), F.lit(LARGEST)), F.lit(-LARGEST)).cast("long"))
    return rows.where(fine).select(F.col(f"`{id_col}`").alias("vec_id"), whole.alias("x"))


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    x = b.column(b.schema.get_field_index("x"))
    return x.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def _moved(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: 64-bit numbers where they fit, else Python's."""
    most = n * max(int(np.abs(x).max(initial=0)), 1) + max(map(abs, sums), default=0)
    return x * n - np.array(sums, dtype=np.int64) if most < 1 << 62 else x.astype(object) * n - np.array(sums, dtype=object)


def sums_of(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of vectors and the sum of each dimension, exact."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, [0] * dim
        for b in slices(batches, 4096):
            n, s = n + b.num_rows, [p + int(q) for p, q in zip(s, _matrix(b).sum(axis=0))]
        if n:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(dim), pa.int32()), "n": pa.array([n] * dim, pa.int64()), "s": pa.array([str(v) for v in s])})

    parts = map_arrow(fit.select("x"), add, "i int, n long, s string")
    got = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # a row a dimension
    by = {r["i"]: r for r in got}
    return (by[0]["n"], [int(by[i]["s"]) for i in range(dim)]) if by else (0, [0] * dim)


def covariance_of(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance with divisor n; entries are centred exactly before they are multiplied."""
    dim = len(sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = None
        for b in slices(batches, 4096):
            d = np.asarray(_moved(_matrix(b), n, sums), dtype=np.float64) / n
            v = d.T @ d if v is None else v + d.T @ d
        if v is not None:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(dim), pa.int32()), "row": pa.array(list(v), pa.list_(pa.float64()))})

    cells = map_arrow(fit.select("x"), add, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    out = np.zeros((dim, dim))
    for r in cells.groupBy("i", "j").agg(F.sum("v").alias("v")).toLocalIterator():  # dim * dim numbers
        out[r["i"], r["j"]] = r["v"] / n
    return (out + out.T) / 2


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of the tridiagonal matrix with the eigenvalues of a symmetric one, by reflections."""
    a = np.array(a, dtype=float)
    for k in range(len(a) - 2):
        x = a[k + 1 :, k]
        size = float(np.linalg.norm(x))
        if size == 0 or not np.any(x[1:]):
            continue
        u = x.copy()
        u[0] += np.copysign(size, x[0])
        u /= np.linalg.norm(u)
        a[k + 1 :, k:] -= 2 * np.outer(u, u @ a[k + 1 :, k:])
        a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ u, u)
    return np.diag(a).copy(), np.diag(a, -1).copy()


def above(t: tuple[np.ndarray, np.ndarray], shift: float) -> int:
    """Eigenvalues above the shift: positive pivots of the shifted matrix (Sylvester's law of inertia)."""
    d, e = t
    tiny = EPS * max(1e-300, float(np.abs(d).max(initial=0)) + float(np.abs(e).max(initial=0)))
    count, q = 0, 1.0
    for i in range(len(d)):
        q = float(d[i]) - shift - (float(e[i - 1]) ** 2 / q if i else 0.0)
        if abs(q) < tiny * EPS:
            q = -tiny * EPS
        count += q > 0
    return count


def intervals_of(t: tuple[np.ndarray, np.ndarray], k: int, most: int = 2) -> list[tuple[float, float, int]]:
    """Intervals ``(a, b, eigenvalues in it)``, from the top down, that hold the largest ``k`` eigenvalues and are free of others where these
    can be told apart: halved until one holds at most ``most``, or its width is at the rounding of the largest.
    """
    d, e = t
    radius = np.abs(np.concatenate([[0.0], e])) + np.abs(np.concatenate([e, [0.0]]))
    hi, lo = float((d + radius).max()), float((d - radius).min())
    pad = max(abs(hi), abs(lo)) * 1e-3 + 1e-300
    todo, out, found = [(lo - pad, hi + pad, len(d), 0)], [], 0
    width = 64 * EPS * max(abs(hi), abs(lo))
    while todo and found < k:
        a, b, low, high = todo.pop()  # how many are above a, and above b
        if low == high:
            continue
        if b - a <= width or low - high <= most and (low <= k or low - high == 1):
            out.append((a, b, low - high))
            found += low - high
            continue
        m = (a + b) / 2
        mid = above(t, m)
        todo += [(a, m, low, mid), (m, b, mid, high)]  # the upper half is next
    return out


def _solve_tasks(spark: SparkSession, v: np.ndarray, jobs: list[tuple[int, float, float, np.ndarray]]) -> dict[int, np.ndarray]:
    """The filtered block of each interval ``(number, a, b, block)``: sums of its quadrature points, each a task that solves a complex shifted system."""
    held = spark.sparkContext.broadcast((v, {k: y for k, _, _, y in jobs}))  # a matrix and blocks of the dimension, whatever the rows
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    rows = [(k, i, a, b, float(x), float(w)) for k, a, b, _ in jobs for i, (x, w) in enumerate(zip(nodes, weights))]
    points = spark.createDataFrame(rows, "k int, i int, a double, b double, x double, w double").repartition(min(len(rows), 64), "k", "i")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, blocks = held.value
        for b in batches:
            for r in b.to_pylist():
                half, turn = (r["b"] - r["a"]) / 2, np.exp(1j * np.pi / 2 * (1 - r["x"]))
                z = (r["a"] + r["b"]) / 2 + half * turn
                q = (r["w"] / 2 * half * turn * np.linalg.solve(z * np.eye(len(m)) - m, blocks[r["k"]].astype(complex))).real
                yield pa.RecordBatch.from_pydict({"k": pa.array([r["k"]], pa.int32()), "i": pa.array([r["i"]], pa.int32()), "q": pa.array([q.ravel()], pa.list_(pa.float64()))})

    out: dict[int, np.ndarray] = {}
    try:
        for r in sorted(map_arrow(points, solve, "k int, i int, q array<double>").collect(), key=lambda r: (r["k"], r["i"])):
            out[r["k"]] = out.get(r["k"], 0) + np.array(r["q"])
    finally:
        held.unpersist()
    return {k: out[k].reshape(y.shape) for k, _, _, y in jobs}


def feast(spark: SparkSession, v: np.ndarray, k: int, rounds: int = 30, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The largest ``k`` eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns.

    Inertia counts cut the axis into intervals with known numbers of eigenvalues. In every round the contour integral
    around an interval filters its block of vectors, and Rayleigh-Ritz takes the eigenpairs out of it, until residuals are
    at rounding and as many lie inside as were counted; fewer or more is an error.
    """
    dim, size = len(v), float(np.abs(v).sum(axis=1).max(initial=0))
    if size == 0:
        return np.zeros(k), np.eye(dim)[:, :k]
    v, rng = v / size, np.random.default_rng(seed)
    spans = intervals_of(tridiagonal(v), k)
    spans = [(a, max(b, a + 1e-9), c) for a, b, c in spans]  # a contour needs some width; what else lies inside is sorted out below
    blocks = {i: np.linalg.qr(rng.standard_normal((dim, min(dim, 2 * c + 4))))[0] for i, (_, _, c) in enumerate(spans)}
    done: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for turn in range(rounds):
        open_ = [i for i in blocks if i not in done]
        if not open_:
            break
        got = _solve_tasks(spark, v, [(i, spans[i][0], spans[i][1], blocks[i]) for i in open_])
        for i in open_:
            a, b, count = spans[i]
            q, _ = np.linalg.qr(got[i])
            e, w = np.linalg.eigh(q.T @ v @ q)
            x = q @ w
            rest = np.linalg.norm(v @ x - x * e, axis=0)
            near = np.maximum(np.maximum(a - e, e - b), 0)
            best = np.lexsort((rest, near))[:count]
            if len(best) == count and rest[best].max() <= 64 * EPS and near[best].max() <= 64 * EPS:
                order = best[np.argsort(-e[best], kind="stable")]
                done[i] = e[order], x[:, order]
            else:
                blocks[i] = x if turn % 8 < 7 else np.linalg.qr(x + 1e-3 * rng.standard_normal(x.shape))[0]
    if len(done) < len(spans):
        raise ValueError(f"eigenvalues counted but not found in {[spans[i] for i in blocks if i not in done]}")
    e = np.concatenate([done[i][0] for i in range(len(spans))])
    x, r = np.linalg.qr(np.concatenate([done[i][1] for i in range(len(spans))], axis=1))
    x = x * np.sign(np.diag(r))
    keep = np.argsort(-e, kind="stable")[:k]
    x = x[:, keep]
    return e[keep] * size, x * np.where(x[np.abs(x).argmax(axis=0), range(x.shape[1])] < 0, -1.0, 1.0)


def _whiten(x: np.ndarray, n: int, sums: list[int], parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact moved vectors, and the centred ones projected on the scaled components."""
    moved = _moved(x, n, sums)
    return moved, (np.asarray(moved, dtype=np.float64) / n) @ parts


def identity_error(fit: DataFrame, n: int, sums: list[int], parts: np.ndarray) -> float:
    """The largest entry, without sign, of the whitened fit list's covariance less the identity."""
    k = parts.shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros((k + 1, k))
        for b in slices(batches, 4096):
            w = _whiten(_matrix(b), n, sums, parts)[1]
            got += np.concatenate([w.T @ w, w.sum(axis=0, keepdims=True)])
        yield pa.RecordBatch.from_pydict({"i": pa.array(range((k + 1) * k), pa.int32()), "v": pa.array(got.ravel())})

    rows = map_arrow(fit.select("x"), add, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # k * (k + 1) rows
    got = np.zeros((k + 1) * k)
    for r in rows:
        got[r["i"]] = r["v"] / n
    got = got.reshape(k + 1, k)
    return float(np.abs(got[:k] - np.outer(got[k], got[k]) - np.eye(k)).max(initial=0))


def whiten(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = 4, scale: int = 256) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for every usable row and each of the first ``k`` components.

    The fit list is every distinct whole-number vector once; copies are folded before the shuffle. Its sums and covariance
    are added up by tasks, and the largest eigenpairs come from :func:`feast`. Nothing but numbers of the dimension
    (its square at most) reaches the driver.

    Rows with a null vector, or with a null or non-finite entry, are left out; so are vectors of another length than
    most usable rows have (of equally frequent lengths the longest counts) and empty ones. Null and repeated ids stay as
    they are. There are as many components as dimensions where these are fewer than ``k``. A component without variance
    (an eigenvalue at the rounding of the largest, as with a single vector) has ``whitened`` null and no part in
    ``identity_error``. Entries beyond 2^40 stop there; a ``deviation`` beyond 64 bits is null. Other columns are ignored.
    Eigenvectors have their largest entry positive. Empty tables give no rows.
    """
    spark = rows.sparkSession
    all_rows = materialize(integer_vectors(rows, id_col, vector, scale), "whitening-vectors")
    kind = all_rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    lengths = all_rows.groupBy(F.size("x").alias("dim")).count().where("dim > 0").orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    dim = lengths[0]["dim"]
    some = all_rows.where(F.size("x") == dim)
    fit = materialize(some.select("x").distinct(), "whitening-fit")
    n, sums = sums_of(fit, dim)
    v = covariance_of(fit, n, sums)
    k, trace = min(k, dim), float(np.trace(v))
    values, vectors = feast(spark, v, k)
    live = values > dim * EPS * max(values.max(), 0)
    parts = vectors / np.sqrt(np.where(live, values, 1.0))
    error = identity_error(fit, n, sums, parts[:, live]) if live.any() else 0.0
    explained = [float(e) / trace if alive and trace > 0 else 0.0 for e, alive in zip(values, live)]
    id_type = pa.int64() if kind == "bigint" else None

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            moved, w = _whiten(_matrix(b), n, sums, parts)
            if moved.dtype == object or dim * int(np.abs(moved).max(initial=0)) ** 2 >= 1 << 63:
                exact = [sum(int(d) ** 2 for d in r) for r in moved]
                deviation = pa.array([d if d < 1 << 63 else None for d in exact], pa.int64())
            else:
                deviation = pa.array((moved * moved).sum(axis=1), pa.int64())
            ids = b.column(b.schema.get_field_index("vec_id"))
            for c in range(k):
                white = pa.array(w[:, c]) if live[c] else pa.nulls(b.num_rows, pa.float64())
                full = lambda value, t: pa.array(np.full(b.num_rows, value), t)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [ids if id_type is None else ids.cast(id_type), full(c + 1, pa.int32()), full(n, pa.int64()), deviation, white, full(explained[c], pa.float64()), full(error, pa.float64())],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return map_arrow(some, out, schema)
