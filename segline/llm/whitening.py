"""Embedding whitening: exact cross-products by bit planes, centred as integers, then eigenvectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import batches_of, rows
from .storage import Workspace

SCALE = 256
#: Rows of a block of bit planes: 64 words a plane.
BLOCK = 4096
#: Entries beyond this are refused: their products have no exact place in a long.
MOST = 1 << 40


def _integers(vectors: DataFrame) -> DataFrame:
    """vec_id, n (entries), x (their longs floor(SCALE * c), packed); vectors that are null or hold null or non-finite entries are left out."""
    schema = pa.schema([("vec_id", pa.int64()), ("n", pa.int64()), ("x", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]):
        def found():
            for batch in batches:
                for id_, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    c = v.values.to_numpy(zero_copy_only=False).astype(np.float64) if v.is_valid and not v.values.null_count else None
                    if c is None or not np.isfinite(c).all():
                        continue
                    x = np.floor(c * SCALE)
                    if len(x) and np.abs(x).max() > MOST:
                        raise ValueError(f"vector {id_} has an entry beyond {MOST // SCALE}")
                    yield id_, len(x), x.astype("<i8").tobytes()

        return batches_of(found(), schema)

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, n long, x binary")


def bit_planes(shifted: np.ndarray, bits: int) -> np.ndarray:
    """(dimension, bit, word): bit b of every row's entry of a dimension, 64 rows a word. shifted: rows by dimensions, none negative."""
    n, width = shifted.shape
    out = np.zeros((width, bits, -(-n // 64) * 8), np.uint8)
    for b in range(bits):
        packed = np.packbits((shifted >> b & 1).astype(np.uint8), axis=0)
        out[:, b, : packed.shape[0]] = packed.T
    return out.view(np.uint64)


def cross_products(planes: np.ndarray) -> list[list[int]]:
    """sum over rows of a[i] * a[j] for all i <= j (in row i from j = i on): the sum over bits p of i and q of j of
    2^(p+q) times the ones of their planes' AND. Exact."""
    width, bits, _ = planes.shape
    weight = [[1 << p + q for q in range(bits)] for p in range(bits)]
    out = []
    for i in range(width):
        ones = np.stack([np.bitwise_count(planes[i, p] & planes[i:]).sum(axis=2, dtype=np.int64) for p in range(bits)])
        if 2 * bits + int(planes.shape[2] * 64).bit_length() < 62:
            out.append(np.einsum("pjq,pq->j", ones, np.array(weight, np.int64)).tolist())
        else:
            out.append([sum(weight[p][q] * int(ones[p, j, q]) for p in range(bits) for q in range(bits)) for j in range(width - i)])
    return out


def _matrix(batch_rows: Iterator[tuple], width: int) -> Iterator[np.ndarray]:
    """Blocks of BLOCK rows of packed vectors."""
    held: list[bytes] = []
    for (x,) in batch_rows:
        held.append(x)
        if len(held) == BLOCK:
            yield np.frombuffer(b"".join(held), "<i8").reshape(-1, width)
            held = []
    if held:
        yield np.frombuffer(b"".join(held), "<i8").reshape(-1, width)


def _ranges(fit: DataFrame, width: int) -> list[tuple[int, int, int]]:
    """For each dimension the least and largest entry and the sum, exact: one row a dimension reaches the driver."""
    wide = "decimal(38,0)"
    schema = pa.schema([("i", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64()), ("total", pa.string())])

    def run(batches):
        def found():
            lo = hi = None
            total = [0] * width
            for block in _matrix(rows(batches), width):
                a, b = block.min(axis=0), block.max(axis=0)
                lo, hi = (a, b) if lo is None else (np.minimum(lo, a), np.maximum(hi, b))
                total = [t + s for t, s in zip(total, block.sum(axis=0).tolist(), strict=True)]
            if lo is not None:
                yield from ((i, int(lo[i]), int(hi[i]), str(total[i])) for i in range(width))

        return batches_of(found(), schema)

    parts = fit.select("x").mapInArrow(run, "i int, lo long, hi long, total string")
    found = parts.groupBy("i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum(F.col("total").cast(wide)).alias("total")).collect()
    return [(r["lo"], r["hi"], int(r["total"])) for r in sorted(found, key=lambda r: r["i"])]


def scatter(fit: DataFrame, lows: list[int], bits: int) -> dict[tuple[int, int], int]:
    """sum over rows of (x[i] - lows[i]) * (x[j] - lows[j]) for i <= j, exact, by bit planes. fit: x. The driver gets one
    number for each pair of dimensions; tasks add their blocks up first."""
    width = len(lows)
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("s", pa.string())])
    low = np.array(lows, np.int64)

    def run(batches):
        def found():
            total = None
            for block in _matrix(rows(batches), width):
                part = cross_products(bit_planes(block - low, bits))
                total = part if total is None else [[a + b for a, b in zip(p, q, strict=True)] for p, q in zip(total, part, strict=True)]
            if total is not None:
                yield from ((i, i + k, str(s)) for i, row in enumerate(total) for k, s in enumerate(row))

        return batches_of(found(), schema)

    parts = fit.select("x").mapInArrow(run, "i int, j int, s string")
    return {(r["i"], r["j"]): int(r["s"]) for r in parts.groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}


class Whitening:
    """What is fitted: n distinct vectors, per-dimension sums, eigenvalues falling, their unit eigenvectors as columns, trace."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float):
        self.n, self.sums, self.values, self.vectors, self.trace = n, sums, values, vectors, trace

    @property
    def live(self) -> np.ndarray:
        """Which components have a variance that rounding does not explain."""
        top = self.values[0] if len(self.values) else 0.0
        return self.values > max(top, 0.0) * len(self.values) * np.finfo(np.float64).eps

    def project(self, x: np.ndarray, k: int) -> np.ndarray:
        """Whitened rows: x less the mean, on the first k components, over the root of each one's eigenvalue; 0 if that is 0."""
        z = (x - np.array([s / self.n for s in self.sums])) @ self.vectors[:, :k]
        e, live = self.values[:k], self.live[:k]
        return np.where(live, z / np.sqrt(np.where(live, e, 1.0)), 0.0)


def fit_whitening(fit: DataFrame, width: int) -> Whitening:
    """Eigenvectors of the covariance of the rows of fit (x: packed longs, distinct). n * sum(x x') - S S' is made of whole
    numbers and divided by n * n only then. The sign of a component makes its largest entry positive."""
    n = fit.count()
    if n == 0 or width == 0:
        return Whitening(n, [0] * width, np.zeros(width), np.eye(width), 0.0)
    ranges = _ranges(fit, width)
    lows, sums = [r[0] for r in ranges], [r[2] for r in ranges]
    bits = max(1, max(hi - lo for lo, hi, _ in ranges).bit_length())
    shifted = [s - n * lo for s, lo in zip(sums, lows, strict=True)]
    v = np.zeros((width, width))
    for (i, j), c in scatter(fit, lows, bits).items():
        v[i, j] = v[j, i] = (n * c - shifted[i] * shifted[j]) / (n * n)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    largest = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.where(vectors[largest, np.arange(width)] < 0, -1.0, 1.0)
    return Whitening(n, sums, values, vectors, float(np.trace(v)))


def identity_error(fit: DataFrame, w: Whitening, k: int) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity, as measured over fit, over those of the
    first k components that vary. Rows are centred before they are multiplied."""
    live = np.flatnonzero(w.live[:k]).tolist()
    if not live:
        return 0.0
    width = len(w.sums)
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("s", pa.float64())])

    def run(batches):
        def found():
            total = np.zeros((k, k))
            for block in _matrix(rows(batches), width):
                z = w.project(block, k)
                total += z.T @ z
            yield from ((i, j, float(total[i, j])) for i in live for j in live)

        return batches_of(found(), schema)

    found = fit.select("x").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    return max(abs(r["s"] / w.n - (r["i"] == r["j"])) for r in found)


def whiten(vectors: DataFrame, components: int = 4) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error for each row of vectors and each of
    the first components (as many as there are dimensions, if fewer). vectors: vec_id, embedding; others are ignored.

    Entries become floor(256 * c); the fit list holds each distinct vector of them once: n of them, sums S. deviation
    is the exact sum of (n * x - S)^2 as decimal(38,0). A component without variance gives 0 for whitened and explained.
    Null vectors and such with null or non-finite entries take no part, nor do vectors of another length than most
    (ties: the longer), nor entries beyond 2^32, which are an error. Repeated rows and null ids stay rows of their
    own; an empty table gives an empty one. The driver holds one number for each pair of dimensions.
    """
    ws = Workspace(vectors.sparkSession, "whiten")
    x = ws.save(_integers(vectors), "integers")
    lengths = x.groupBy("n").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    width = lengths["n"] if lengths else 0
    x = x.where(F.col("n") == width)
    fit = ws.save(x.select("x").distinct(), "fit")
    w = fit_whitening(fit, width)
    k = min(components, width)
    error = identity_error(fit, w, k)
    share = [float(e / w.trace) if live and w.trace > 0 else 0.0 for e, live in zip(w.values[:k], w.live[:k], strict=True)]
    n, sums = w.n, w.sums
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("deviation", pa.string()), ("whitened", pa.float64()), ("explained", pa.float64())])

    def run(batches):
        def found():
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(at, BLOCK)
                    block = np.frombuffer(b"".join(part.column(1).to_pylist()), "<i8").reshape(-1, width)
                    z = w.project(block, k)
                    largest = n * max(abs(int(block.min(initial=0))), int(block.max(initial=0))) + max(map(abs, sums), default=0)
                    if largest**2 * width < 1 << 62:
                        far = ((n * block - np.array(sums)) ** 2).sum(axis=1).tolist()
                    else:  # whole numbers of any size
                        far = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in block.tolist()]
                    for id_, deviation, y in zip(part.column(0).to_pylist(), far, z.tolist(), strict=True):
                        yield from ((id_, c + 1, str(deviation), y[c], share[c]) for c in range(k))

        return batches_of(found(), schema)

    out = x.select("vec_id", "x").mapInArrow(run, "vec_id long, component int, deviation string, whitened double, explained double")
    return out.select("vec_id", "component", F.lit(n).cast("long").alias("n"), F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened", "explained", F.lit(error).alias("identity_error"))
