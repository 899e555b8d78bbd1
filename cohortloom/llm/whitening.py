"""Whitening of embeddings by a bidiagonal qd solver.

Tasks reduce their centred rows block by block to a triangular factor; factors are
stacked and reduced again until one is left, a square of the vectors' length. Householder
reflections make it bidiagonal, the differential qd algorithm with shifts (dqds) finds its
singular values, and twisted factorisations its right singular vectors: the directions
in which the rows have unit variance after division by the deviations. Where values lie
too close for that, inverse iteration from the twisted vector keeps vectors orthogonal.

Only counts, sums and factors whose size depends on the length of the vectors alone reach
the driver. Entries are integers, so sums and squared deviations are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.session import discard, stage

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: Larger entries count as this one, so that integers stay exact as doubles.
LARGEST = 1 << 53
BLOCK_ROWS = 4096
#: Factors that one task stacks.
FAN_IN = 16
EPS = float(np.finfo(np.float64).eps)
#: Singular values below this part of the largest count as zero.
RANK = 1e-12
#: Values closer than this, in relation to their size, have their vectors made orthogonal.
CLUSTER = 1e-3
SPLIT_BITS = 20
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which vectors count, and of these all entries: row (among those that count), dimension, integer."""
    lists = column.cast(pa.list_(pa.float64()))
    values = lists.flatten().to_numpy(zero_copy_only=False)
    owner = np.asarray(pc.list_parent_indices(lists), np.int64)
    good = np.asarray(lists.is_valid())
    good[owner[~np.isfinite(values)]] = False
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
    dims = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    kept = good[owner]
    rows = (np.cumsum(good) - 1)[owner[kept]]
    with np.errstate(over="ignore"):
        scaled = np.clip(np.floor(values[kept] * SCALE), -LARGEST, LARGEST).astype(np.int64) + SHIFT
    return good, rows, dims[kept], scaled


def sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors that count and the exact sum of each dimension; shorter vectors end in zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, parts = 0, [np.zeros(0, np.int64)] * 3
        for batch in batches:
            good, _, dims, x = entries(batch.column("embedding"))
            n += int(good.sum())
            if len(dims):
                size = max(len(parts[0]), int(dims.max()) + 1)
                parts = [np.pad(p, (0, size - len(p))) for p in parts]
                for p, add in zip(parts, (np.ones_like(x), x >> SPLIT_BITS, x & ((1 << SPLIT_BITS) - 1))):
                    np.add.at(p, dims, add)
        size = len(parts[0])
        yield pa.RecordBatch.from_pydict({
            "dim": pa.array(np.arange(-1, size), pa.int64()),
            "n": pa.array(np.concatenate([[n], parts[0]]), pa.int64()),
            "high": pa.array(np.concatenate([[0], parts[1]]), pa.int64()),
            "low": pa.array(np.concatenate([[0], parts[2]]), pa.int64()),
        })

    total = [F.sum(F.col(c).cast("decimal(28,0)")).alias(c) for c in ("n", "high", "low")]
    found = vectors.mapInArrow(run, "dim long, n long, high long, low long").groupBy("dim").agg(*total).collect()
    by_dim = {r["dim"]: (int(r["n"]), (int(r["high"]) << SPLIT_BITS) + int(r["low"])) for r in found}
    n = by_dim.pop(-1, (0, 0))[0]
    return n, [by_dim[d][1] + (n - by_dim[d][0]) * SHIFT for d in range(len(by_dim))]


class Centre:
    """Centres integer rows at ``S / n`` without rounding ``n * x - S``."""

    def __init__(self, n: int, total: list[int]):
        self.n, self.width = n, len(total)
        self.base = np.array([s // n for s in total], np.int64)
        self.rest = [s % n for s in total]
        self.part = np.array([r / n for r in self.rest])

    def whole(self, batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
        """The ids of the vectors that count and their integer rows less the whole part of the mean."""
        good, rows, dims, x = entries(batch.column("embedding"))
        out = np.full((int(good.sum()), self.width), SHIFT, np.int64)
        out[rows, dims] = x
        ids = batch.column("vec_id").filter(pa.array(good)) if "vec_id" in batch.schema.names else None
        return ids, out - self.base

    def centred(self, whole: np.ndarray) -> np.ndarray:
        return whole - self.part

    def deviations(self, whole: np.ndarray) -> list[int | None]:
        """The exact sum of ``(n * x - S) ** 2`` of each row; null if it takes more than 64 bits."""
        n, squares = self.n, sum(r * r for r in self.rest)
        low = max(1, max(self.rest, default=1))
        if self.width and (not whole.size or int(np.abs(whole).max()) * max(int(np.abs(whole).max()), low) * self.width < 1 << 62):
            own = (whole * whole).sum(axis=1).tolist()
            mixed = (whole * np.array(self.rest, np.int64)).sum(axis=1).tolist()
        else:
            held = whole.astype(object)
            own, mixed = (held * held).sum(axis=1).tolist(), (held * np.array(self.rest, object)).sum(axis=1).tolist()
        exact = [n * n * int(a) - 2 * n * int(b) + squares for a, b in zip(own, mixed)]
        return [v if v < 1 << 63 else None for v in exact]


def triangle(blocks: Iterator[np.ndarray], width: int) -> np.ndarray:
    """The triangular factor of all rows: blocks are stacked below the factor so far and reduced."""
    factor = np.zeros((0, width))
    waiting: list[np.ndarray] = []
    size = 0
    for block in blocks:
        waiting.append(block)
        size += len(block)
        if size >= BLOCK_ROWS:
            factor, waiting, size = np.linalg.qr(np.concatenate([factor, *waiting]), mode="r"), [], 0
    if size:
        factor = np.linalg.qr(np.concatenate([factor, *waiting]), mode="r")
    return factor


def factor_rows(factor: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"row": pa.array([r.tobytes() for r in factor], pa.binary())})


def triangular(vectors: DataFrame, centre: Centre) -> np.ndarray:
    """The square triangular factor of all centred rows, reduced in a tree of ``FAN_IN`` factors a task."""
    width = centre.width

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield factor_rows(triangle((centre.centred(centre.whole(b)[1]) for b in batches), width))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stacked = (np.frombuffer(b"".join(b.column("row").to_pylist()), np.float64).reshape(-1, width) for b in batches)
        yield factor_rows(triangle(stacked, width))

    held = stage(vectors.mapInArrow(first, "row binary"), "factors")
    count = held.count()
    while True:
        tasks = -(-count // (FAN_IN * width))
        after = stage(held.repartition(tasks).mapInArrow(again, "row binary"), "factors")
        discard(held)
        held = after
        if tasks == 1:
            break
        count = held.count()
    rows = [np.frombuffer(r["row"], np.float64) for r in held.collect()]
    discard(held)
    out = np.zeros((width, width))
    out[: len(rows)] = np.array(rows).reshape(-1, width)
    return out


def bidiagonal(square: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and superdiagonal of ``U' square V``, and the orthogonal ``V``, by Householder reflections."""
    a = square.copy()
    n = len(a)
    v = np.eye(n)
    for k in range(n):
        u = reflector(a[k:, k])
        a[k:, k:] -= np.outer(u, 2 * (u @ a[k:, k:]))
        if k < n - 2:
            w = reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= np.outer(2 * (a[k:, k + 1 :] @ w), w)
            v[:, k + 1 :] -= np.outer(2 * (v[:, k + 1 :] @ w), w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def reflector(x: np.ndarray) -> np.ndarray:
    """The unit vector whose reflection turns ``x`` into a multiple of the first axis; zero if ``x`` is."""
    size = np.linalg.norm(x)
    u = x.copy()
    if size == 0:
        return u
    u[0] += math.copysign(size, x[0])
    return u / np.linalg.norm(u)


def transformed(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One dqds step; none if the shift was beyond the least eigenvalue."""
    new_q, new_e = [0.0] * len(q), [0.0] * len(e)
    d = q[0] - shift
    for k in range(len(e)):
        if d < 0:
            return None
        new_q[k] = d + e[k]
        t = q[k + 1] / new_q[k] if new_q[k] else 0.0
        new_e[k] = e[k] * t
        d = d * t - shift
    if d < 0:
        return None
    new_q[-1] = d
    return new_q, new_e


def squared_singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """The squares of the singular values of a bidiagonal matrix, falling, each to high relative accuracy (dqds)."""
    found: list[float] = []
    tiny = EPS * EPS
    segments = [([float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in above], 0.0)]
    while segments:
        q, e, sigma = segments.pop()
        while q:
            if len(q) == 1:
                found.append(sigma + q.pop())
                break
            scale = sigma + q[-1]
            if e[-1] <= tiny * scale or e[-1] * q[-1] <= tiny * scale * (q[-2] + e[-1]) and e[-1] <= EPS * scale:
                found.append(sigma + q.pop())
                e.pop()
                continue
            cut = next((k for k in range(len(e) - 1) if e[k] <= tiny * (sigma + min(q[k], q[k + 1]))), None)
            if cut is not None:
                segments.append((q[: cut + 1], e[:cut], sigma))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if q[0] < q[-1]:
                # Small values should come off at the end.
                q, e = q[::-1], e[::-1]
            # The last two rows bound the least eigenvalue from above.
            p, off, r = q[-2] + (e[-2] if len(e) > 1 else 0.0), q[-2] * e[-1], q[-1] + e[-1]
            half = (p + r) / 2
            high = half + math.sqrt(((p - r) / 2) ** 2 + off)
            shift = max(0.0, (p * r - off) / high if high else 0.0) * (1 - 1e-10)
            for tried in (shift, shift / 4, shift / 64, 0.0):
                step = transformed(q, e, tried)
                if step is not None:
                    q, e = step
                    sigma += tried
                    break
    return np.sort(np.array(found))[::-1]


def twisted(diagonal: np.ndarray, ratio: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, int]:
    """The twisted factorisation of ``L D L' - value``: both triangular halves and the twist.

    ``L`` has ones and ``ratio`` below them. The twist is where the pivot is least.
    """
    n, tiny = len(diagonal), np.finfo(np.float64).tiny / EPS
    down, up = np.zeros(max(n - 1, 0)), np.zeros(max(n - 1, 0))
    s, p = np.zeros(n), np.zeros(n)
    s[0], p[-1] = -value, diagonal[-1] - value
    for k in range(n - 1):
        down[k] = diagonal[k] * ratio[k] / (s[k] + diagonal[k] or tiny)
        s[k + 1] = down[k] * ratio[k] * s[k] - value
    for k in range(n - 2, -1, -1):
        t = diagonal[k] / (diagonal[k] * ratio[k] ** 2 + p[k + 1] or tiny)
        up[k] = ratio[k] * t
        p[k] = p[k + 1] * t - value
    return down, up, int(np.argmin(np.abs(s + p + value)))


def null_vector(down: np.ndarray, up: np.ndarray, twist: int) -> np.ndarray:
    """The vector that the twisted factors send to the pivot at the twist."""
    z = np.zeros(len(down) + 1)
    z[twist] = 1.0
    for k in range(twist - 1, -1, -1):
        z[k] = -down[k] * z[k + 1]
    for k in range(twist, len(up)):
        z[k + 1] = -up[k] * z[k]
    return z / np.linalg.norm(z)


def solved(diagonal: np.ndarray, beside: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The solution of a symmetric tridiagonal system by elimination with row exchanges, scaled to length one."""
    n, least = len(b), EPS * max(np.abs(diagonal).max(), np.abs(beside).max(initial=0.0), np.finfo(np.float64).tiny)
    d, below, y = diagonal.tolist(), beside.tolist(), b.tolist()
    above, second = below + [0.0], [0.0] * n
    for k in range(n - 1):
        if abs(d[k]) >= abs(below[k]):
            f = below[k] / (d[k] or least)
            d[k + 1] -= f * above[k]
            y[k + 1] -= f * y[k]
        else:
            f, d[k] = d[k] / below[k], below[k]
            d[k + 1], above[k] = above[k] - f * d[k + 1], d[k + 1]
            second[k], above[k + 1] = above[k + 1], -f * above[k + 1]
            y[k], y[k + 1] = y[k + 1], y[k] - f * y[k + 1]
    for k in range(n - 1, -1, -1):
        rest = y[k] - (above[k] * y[k + 1] if k + 1 < n else 0.0) - (second[k] * y[k + 2] if k + 2 < n else 0.0)
        y[k] = rest / (d[k] if abs(d[k]) > least else least)
        if abs(y[k]) > 1e200:
            y = [v * 1e-200 for v in y]
    out = np.array(y)
    out /= np.abs(out).max()
    return out / np.linalg.norm(out)


def right_vectors(diagonal: np.ndarray, above: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Squares of the greatest singular values of a bidiagonal matrix, falling, and their right vectors as columns."""
    n = len(diagonal)
    scale = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0))
    if scale == 0:
        return np.zeros(0), np.zeros((n, 0))
    above = np.where(np.abs(above) <= EPS * scale, 0.0, above)
    borders = [0, *(np.flatnonzero(above == 0) + 1).tolist(), n]
    rng = np.random.default_rng(n)
    found: list[tuple[float, np.ndarray]] = []
    for low, high in zip(borders[:-1], borders[1:]):
        own, off = diagonal[low:high].copy(), above[low : high - 1]
        small = np.abs(own) < EPS * scale
        own[small] = EPS * scale
        squares, ratio = own * own, off / own[:-1]
        values = squared_singular_values(own, off)[:most]
        whole, beside = squares + np.append(0.0, off * off), own[:-1] * off
        cluster: list[np.ndarray] = []
        for k, value in enumerate(values.tolist()):
            if k and values[k - 1] - value > CLUSTER * value:
                cluster = []
            down, up, twist = twisted(squares, ratio, value)
            z = null_vector(down, up, twist)
            if cluster:
                basis = np.array(cluster)
                z = z - basis.T @ (basis @ z)
                if np.linalg.norm(z) < 0.1:
                    z = rng.normal(size=len(z))
                for _ in range(4):
                    z = solved(whole - value, beside, z)
                    for _ in range(2):
                        z = z - basis.T @ (basis @ z)
                        z /= np.linalg.norm(z)
            cluster.append(z)
            out = np.zeros(n)
            out[low:high] = z
            found.append((value, out))
    found.sort(key=lambda f: -f[0])
    kept = [f for f in found[:most] if f[0] > (RANK * RANK) * found[0][0]]
    return np.array([f[0] for f in kept]), np.array([f[1] for f in kept]).T


def principal(square: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Variances along the leading directions, falling, the directions as columns, and the total variance."""
    diagonal, above, v = bidiagonal(square)
    values, vectors = right_vectors(diagonal, above, most)
    return values / n, v @ vectors, float((square * square).sum()) / n


def identity_error(vectors: DataFrame, centre: Centre, project: np.ndarray) -> float:
    """The largest entry of the covariance of the whitened rows less the identity."""
    k = project.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = centre.centred(centre.whole(batch)[1]) @ project
            total[:k] += w.T @ w
            total[k] += w.sum(axis=0)
        yield pa.RecordBatch.from_pydict({"place": pa.array(np.arange(total.size), pa.int32()), "part": pa.array(total.ravel())})

    found = vectors.mapInArrow(run, "place int, part double").groupBy("place").agg(F.sum("part").alias("part")).collect()
    total = np.zeros((k + 1) * k)
    for r in found:
        total[r["place"]] = r["part"] / centre.n
    total = total.reshape(k + 1, k)
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of ``vectors (vec_id, embedding)``.

    Vectors that are null or hold null or non-finite entries are left out. Of the others,
    each entry ``c`` is the integer ``floor(64 * c) + 1000000``. All of them are fitted and
    projected: a row for each vector and each of the leading ``components`` directions
    of positive variance. Vectors shorter than the longest one end in zeros. Rows without an id
    and repeated rows count like others. ``deviation`` is null where it takes more than 64
    bits. Without vectors, or if all are equal, there are no rows.
    """
    spark = vectors.sparkSession
    held = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bare = held.select("embedding")
    n, total = sums(bare)
    if not n or not total:
        return spark.createDataFrame([], OUT)
    centre = Centre(n, total)
    variance, directions, trace = principal(triangular(bare, centre), n, components)
    if not len(variance):
        return spark.createDataFrame([], OUT)
    project = directions / np.sqrt(variance)
    error = identity_error(bare, centre, project)
    explained, k = variance / trace, len(variance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                ids, whole = centre.whole(batch.slice(low, 1024))
                rows = len(whole)
                each = pa.array(np.repeat(np.arange(rows), k))
                yield pa.RecordBatch.from_pydict({
                    "vec_id": ids.take(each),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    "n": pa.array(np.full(rows * k, n, np.int64)),
                    "deviation": pa.array(centre.deviations(whole), pa.int64()).take(each),
                    "whitened": pa.array((centre.centred(whole) @ project).ravel()),
                    "explained": pa.array(np.tile(explained, rows)),
                    "identity_error": pa.array(np.full(rows * k, error)),
                })

    return held.mapInArrow(run, OUT)
