"""Whitening of embeddings with a covariance from variances alone (polarisation).

Entries become longs x = floor(64 c) + 1,000,000. A first pass adds them up by dimension. A second
one adds up, for every dimension and every sum of two dimensions, the squares of the values less
the whole number nearest to their mean; with the exact remainder of that centre these squares give
Q = sum (n x - S)^2 as whole numbers. Since (a + b)^2 = a^2 + 2ab + b^2, the covariance of two
dimensions is half of what the variance of their sum has over their own two. The matrix is
decomposed by ``eigh`` on the driver: it grows with the square of the dimensions, never with the
rows. A last pass projects; the covariance of what it wrote is measured over all rows again.

Squares are added up in 64-bit integers where a bound on the largest entry of the batch proves
that they fit, and in whole numbers of any size otherwise; both are exact.

Defined results: vectors that are null, empty, or hold a null or non-finite entry are dropped;
vectors of another length are a space of their own with its own n, sums and components. Entries
whose x needs more than 61 bits are set to the nearest that does not. Null and repeated ids and
repeated rows count and come out like any others. A component without variance, as for a single
row, has whitened and explained 0 (and identity_error is then 1); a deviation over 63 bits is
null. No rows give no rows. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triage.llm.tables import Table, map_arrow

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Rows whose pair sums are formed at once.
BLOCK = 2048
#: Bytes of all projections that are broadcast: 32 components of a million dimensions in all.
MOST_BYTES = 256 << 20


def usable(c: str) -> Column:
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite, F.lit(False)) & (F.size(c) > 0)


def whole(c: np.ndarray) -> np.ndarray:
    """x of entries c."""
    edge = float(1 << 61)
    return np.clip(np.floor(SCALE * c.astype(np.float64)), -edge, edge - SHIFT - 1024).astype(np.int64) + SHIFT


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows' places, x by row) for every length of vector in the batch, a block of rows at a time."""
    column = batch.column("embedding")
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        for at in range(0, len(own), BLOCK):
            rows = own[at : at + BLOCK]
            flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
            yield int(size), rows, whole(flat.reshape(len(rows), int(size)))


def squares(d: np.ndarray) -> np.ndarray:
    """Sums of squares of all columns and sums of two columns, as a matrix whose diagonal has the columns' own."""
    k = d.shape[1]
    if len(d) and max(-int(d.min()), int(d.max())) > 1 << 24:
        d = d.astype(object)
    out = np.zeros((k, k), dtype=d.dtype)
    for i in range(k):
        out[i, i] = (d[:, i] * d[:, i]).sum()
        t = d[:, i + 1 :] + d[:, i : i + 1]
        out[i, i + 1 :] = (t * t).sum(0)
    return out


@dataclass
class Space:
    """The fitted components of vectors of one length."""

    n: int
    sums: list[int]
    vectors: np.ndarray  # dimension x component
    values: np.ndarray
    explained: np.ndarray

    @property
    def projection(self) -> np.ndarray:
        least = len(self.sums) * np.finfo(float).eps * max(float(self.values[0]), 0.0)
        good = self.values > least
        return self.vectors * np.where(good, 1 / np.sqrt(np.where(good, self.values, 1)), 0)


def centres(n: int, sums: list[int]) -> tuple[list[int], list[int]]:
    """The whole number nearest to each mean, and what n of them leave of the sum."""
    near = [(2 * s + n) // (2 * n) for s in sums]
    return near, [s - n * c for s, c in zip(sums, near, strict=True)]


def decompose(n: int, sums: list[int], a: list[list[int]], most: int) -> Space:
    """Components from squares ``a`` about the centres, upper triangle of whole numbers."""
    _, rest = centres(n, sums)
    k = len(sums)
    own = [n * n * a[i][i] - n * rest[i] * rest[i] for i in range(k)]
    v = np.zeros((k, k))
    for i in range(k):
        v[i, i] = own[i] / n**3
        for j in range(i + 1, k):
            both = n * n * a[i][j] - n * (rest[i] + rest[j]) ** 2
            v[i, j] = v[j, i] = (both - own[i] - own[j]) / (2 * n**3)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    trace = sum(own) / n**3
    return Space(n, sums, vectors, values, np.maximum(values, 0) / trace if trace else np.zeros(len(values)))


def fit(vectors: DataFrame, most: int = COMPONENTS) -> dict[int, Space]:
    """By length of vector the components of (embedding) rows, all of them usable."""
    rows = vectors.select("embedding")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total: dict[int, list] = {}
        for b in batches:
            for size, own, x in matrices(b):
                n, s = total.get(size, (0, 0))
                wide = x.astype(object) if len(x) and max(-int(x.min()), int(x.max())) > 1 << 50 else x
                total[size] = [n + len(own), s + wide.sum(0).astype(object)]
        for size, (n, s) in total.items():
            yield {"size": [size] * size, "i": range(size), "n": [n] * size, "s": [Decimal(int(v)) for v in s]}

    found = (
        map_arrow(rows, "size int, i int, n long, s decimal(38,0)", add)
        .groupBy("size", "i")
        .agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"))
    )
    sums: dict[int, tuple[int, list[int]]] = {}
    for r in found.orderBy("size", "i").collect():  # a row per dimension
        sums.setdefault(r["size"], (r["n"], []))[1].append(int(r["s"]))
    if sum(8 * most * k for k in sums) > MOST_BYTES:
        raise ValueError(f"vectors of {len(sums)} lengths have too many dimensions in all for one model")
    shared = vectors.sparkSession.sparkContext.broadcast({k: centres(*v)[0] for k, v in sums.items()})

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for size, _, x in matrices(b):
                own = squares(x - np.array(shared.value[size], dtype=np.int64))
                total[size] = total.get(size, 0) + own.astype(object)
        for size, a in total.items():
            i, j = np.triu_indices(size)
            for at in range(0, len(i), 1 << 16):
                p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                yield {"size": [size] * len(p), "i": p, "j": q, "a": [Decimal(int(v)) for v in a[p, q]]}

    pairs = Table(
        map_arrow(rows, "size int, i int, j int, a decimal(38,0)", spread)
        .groupBy("size", "i", "j")
        .agg(F.sum("a").cast("decimal(38,0)").alias("a")),
        "pairs",
    )
    out = {}
    for size, (n, s) in sums.items():  # one matrix at a time
        a = [[0] * size for _ in range(size)]
        for r in pairs.df.filter(F.col("size") == size).collect():
            a[r["i"]][r["j"]] = int(r["a"])
        out[size] = decompose(n, s, a, most)
    pairs.drop()
    shared.destroy()
    return out


def transform(vectors: DataFrame, spaces: dict[int, Space]) -> DataFrame:
    """vec_id, size, n, deviation, whitened (array) and explained (array) of every usable row."""
    shared = vectors.sparkSession.sparkContext.broadcast(
        {k: (s.n, s.sums, centres(s.n, s.sums), s.projection, s.explained.tolist()) for k, s in spaces.items()}
    )

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            ids = b.column("vec_id")
            for size, own, x in matrices(b):
                n, sums, (near, rest), projection, explained = shared.value[size]
                d = x - np.array(near, dtype=np.int64)
                white = (d - np.array([r / n for r in rest])) @ projection
                edge = max(-int(d.min()), int(d.max())) * n + n
                if edge * edge * size < 1 << 63:
                    deviation = ((n * d - np.array(rest, dtype=np.int64)) ** 2).sum(1).tolist()
                else:
                    exact = ((n * d.astype(object) - np.array(rest, dtype=object)) ** 2).sum(1)
                    deviation = [int(v) if v < 1 << 63 else None for v in exact]
                k = len(own)
                yield {
                    "vec_id": ids.take(pa.array(own)),
                    "size": [size] * k,
                    "n": [n] * k,
                    "deviation": deviation,
                    "whitened": list(white),
                    "explained": [explained] * k,
                }

    return map_arrow(
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"),
        "vec_id long, size int, n long, deviation long, whitened array<double>, explained array<double>",
        project,
    )


def identity_errors(white: DataFrame) -> dict[int, float]:
    """By length the largest entry of whitened's covariance less the identity, over all rows of ``transform``."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for size, w in _blocks(b):
                total[size] = total.get(size, 0) + w.sum(0)
        for size, s in total.items():
            yield {"size": [size] * len(s), "i": range(len(s)), "s": s}

    counts = {r["size"]: r["n"] for r in white.groupBy("size").agg(F.first("n").alias("n")).collect()}
    means: dict[int, list[float]] = {}
    sums = map_arrow(white, "size int, i int, s double", add).groupBy("size", "i").agg(F.sum("s").alias("s"))
    for r in sums.orderBy("size", "i").collect():
        means.setdefault(r["size"], []).append(r["s"] / counts[r["size"]])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for size, w in _blocks(b):
                w = w - np.array(means[size])
                total[size] = total.get(size, 0) + w.T @ w
        for size, c in total.items():
            i, j = np.indices(c.shape)
            yield {"size": [size] * c.size, "i": i.ravel(), "j": j.ravel(), "c": c.ravel()}

    products = map_arrow(white, "size int, i int, j int, c double", spread).groupBy("size", "i", "j").agg(F.sum("c").alias("c"))
    out = {size: 0.0 for size in means}
    for r in products.collect():  # at most 32 x 32 of a length
        off = abs(r["c"] / counts[r["size"]] - (r["i"] == r["j"]))
        out[r["size"]] = max(out[r["size"]], off)
    return out


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    sizes, column = batch.column("size").to_numpy(), batch.column("whitened")
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        yield int(size), column.take(pa.array(own)).flatten().to_numpy().reshape(len(own), -1)


def whiten(vectors: DataFrame, most: int = COMPONENTS) -> tuple[DataFrame, list[Table]]:
    """Per usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = vectors.filter(usable("embedding"))
    white = Table(transform(rows, fit(rows, most)), "whitened")
    errors = identity_errors(white.df)
    error = F.lit(0.0)
    for size, e in sorted(errors.items()):
        error = F.when(F.col("size") == size, F.lit(float(e))).otherwise(error)
    entries = F.arrays_zip("whitened", "explained")
    out = white.df.select("vec_id", "n", "deviation", error.alias("identity_error"), F.posexplode(entries).alias("k", "e"))
    return (
        out.select(
            "vec_id",
            (F.col("k") + 1).cast("int").alias("component"),
            "n",
            "deviation",
            F.col("e.whitened").alias("whitened"),
            F.col("e.explained").alias("explained"),
            "identity_error",
        ),
        [white],
    )
