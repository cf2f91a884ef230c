"""Centroid clustering of whole-number vectors by exponion search: exact, with bounds that spare most distances.

A vector keeps an upper bound of the distance to its centroid and a lower one to any other. Where they don't decide, only centroids
in a ball around its own are scanned, found in that centroid's sorted list of distances to the others. The ball's radius is twice
the upper bound plus the distance to the nearest other centroid: nearest and second nearest are in it, ties too, as its rim counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

#: Components are at most this large: squared distances of 64 of them then fit a long.
MOST = 1 << 27
#: Bounds are widened by this share at each rounding, so that rounding never decides.
SLACK = 1e-9

#: A row with ``sums`` is a task's part of a cluster: sums by component, then vectors, distances and distances worked out.
STATE = "vec_id long, vector binary, cluster int, upper double, lower double, distance long, sums array<long>"


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of ``x`` to rows of ``c``; by matrix product in doubles where all sums are below 2^53."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    kind = np.float64 if 4 * x.shape[1] * most * most < 1 << 53 else np.int64
    x, c = x.astype(kind), c.astype(kind)
    return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)


class Centroids:
    """Centroids, and the sorted lists of distances between them."""

    def __init__(self, at: np.ndarray, before: np.ndarray | None = None):
        self.at = at
        gap = np.sqrt(squared(at, at).astype(float))
        self.order = np.argsort(gap, axis=1, kind="stable")
        self.sorted = np.take_along_axis(gap, self.order, 1)
        np.fill_diagonal(gap, np.inf)
        self.near = gap.min(1)  # to the nearest other one
        moved = np.zeros(len(at)) if before is None else np.sqrt(((at - before) ** 2).sum(1).astype(float)) * (1 + SLACK)
        self.moved = moved
        # how far any other centroid has moved at most
        self.others = np.array([np.delete(moved, k).max(initial=0.0) for k in range(len(at))])

    def scan(self, x: np.ndarray, own: np.ndarray | None, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(nearest, squared distance, distance to the second) of each row, and how many distances were worked out."""
        nearest, best, second = np.zeros(len(x), np.int32), np.zeros(len(x), np.int64), np.full(len(x), np.inf)
        groups = [(np.arange(len(x)), np.arange(len(self.at)))] if own is None else self._balls(own, upper)
        scanned = 0
        for rows, ids in groups:
            d = squared(x[rows], self.at[ids])
            scanned += d.size
            k = d.argmin(1)  # of equal ones the smallest number
            nearest[rows], best[rows] = ids[k], d[np.arange(len(rows)), k]
            if len(ids) > 1:
                second[rows] = np.sqrt(np.partition(d, 1, axis=1)[:, 1].astype(float))
        return nearest, best, second, scanned

    def _balls(self, own: np.ndarray, upper: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows that scan the same centroids, and these in ascending order."""
        radius = (2 * upper + self.near[own]) * (1 + SLACK)
        for k in np.unique(own):
            rows = np.flatnonzero(own == k)
            inside = np.searchsorted(self.sorted[k], radius[rows], side="right")
            for n in np.unique(inside):
                yield rows[inside == n], np.sort(self.order[k, :n])


def assign(x: np.ndarray, own: np.ndarray | None, upper: np.ndarray, lower: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(cluster, squared distance or -1 where bounds spared it, upper, lower, distances worked out) after the centroids moved to ``c``."""
    if own is None:
        nearest, best, second, scanned = c.scan(x, None, upper)
        return nearest, best, np.sqrt(best.astype(float)) * (1 + SLACK), second * (1 - SLACK), scanned
    own, best = own.copy(), np.full(len(x), -1, np.int64)
    upper = (upper + c.moved[own]) * (1 + SLACK)
    lower = lower - c.others[own] - SLACK * (np.where(np.isfinite(lower), np.abs(lower), 0) + c.others[own])
    open_ = np.flatnonzero(upper >= np.maximum(lower, c.near[own] / 2 * (1 - SLACK)))
    scanned = len(open_)
    for k in np.unique(own[open_]):
        rows = open_[own[open_] == k]
        best[rows] = squared(x[rows], c.at[k : k + 1])[:, 0]
    upper[open_] = np.sqrt(best[open_].astype(float)) * (1 + SLACK)
    open_ = open_[upper[open_] >= np.maximum(lower[open_], c.near[own[open_]] / 2 * (1 - SLACK))]
    if len(open_):
        nearest, found, second, n = c.scan(x[open_], own[open_], upper[open_])
        scanned += n
        own[open_], best[open_] = nearest, found
        upper[open_], lower[open_] = np.sqrt(found.astype(float)) * (1 + SLACK), second * (1 - SLACK)
    return own, best, upper, lower, scanned


def _numbers(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray | None]:
    """The vectors as whole numbers and the clusters they have, if any."""
    n = batch.num_rows
    if "vector" in batch.schema.names:
        col = batch.column("vector")
        flat = np.frombuffer(col.buffers()[2], np.int32)[: width * (col.offset + n)] if n else np.zeros(0, np.int32)
        start = np.frombuffer(col.buffers()[1], np.int32)[col.offset] // 4 if n else 0
        return flat[start : start + n * width].reshape(n, width), batch.column("cluster").to_numpy()
    x = np.floor(1024 * batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(n, width)
    if np.abs(x).max(initial=0) > MOST:
        raise ValueError(f"components of over {MOST} / 1024 have squared distances that a long can't hold")
    return x.astype(np.int32), None


def _pass(at: np.ndarray, before: np.ndarray | None, final: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A round over a task's vectors: each with its state, then a row per cluster with their number, sums and distances."""
    names = [c.split()[0] for c in STATE.split(", ")]
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, (k, width) = Centroids(at, before), at.shape
        rows, sums, inertia, scanned = np.zeros(k, np.int64), np.zeros((k, width), np.int64), np.zeros(k, np.int64), 0
        for b in batches:
            x, own = _numbers(b, width)
            upper, lower = (b.column(n).to_numpy() for n in ("upper", "lower")) if own is not None else (np.zeros(0), np.zeros(0))
            own, best, upper, lower, n = assign(x, own, upper, lower, c)
            scanned += n
            if final:
                for j in np.unique(own[best < 0]):
                    far = (best < 0) & (own == j)
                    best[far] = squared(x[far], at[j : j + 1])[:, 0]
                np.add.at(inertia, own, best)
            for j in np.unique(own):
                sums[j] += x[own == j].sum(0, dtype=np.int64)
            rows += np.bincount(own, minlength=k)
            size = len(x)
            vectors = pa.nulls(size, pa.binary()) if final else pa.Array.from_buffers(pa.binary(), size, [None, pa.py_buffer((np.arange(size + 1, dtype=np.int32) * (4 * width))), pa.py_buffer(np.ascontiguousarray(x))])
            cols = [b.column("vec_id"), vectors, own, upper, lower, best, pa.nulls(size, kinds[-1])]
            yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(cols, kinds, strict=True)], names=names)
        more = np.stack([rows, inertia, np.array([scanned] + [0] * (k - 1))], 1)
        cols = [None, None, np.arange(k), None, None, None, np.concatenate([sums, more], 1).tolist()]
        yield pa.RecordBatch.from_arrays([pa.nulls(k, t) if v is None else pa.array(v, t) for v, t in zip(cols, kinds, strict=True)], names=names)

    return run


def kept_vectors(embeddings: DataFrame, width: int = 64) -> DataFrame:
    """vec_id, embedding (doubles) of vectors with ``width`` components, none null or non-finite."""
    v = F.col("embedding").cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding")).where((F.size("embedding") == width) & F.forall("embedding", fine))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors of the least hashes of ``seed:vec_id`` (a null id comes last; equal ids by their components)."""
    hashed = vectors.withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    rows = hashed.orderBy(F.col("hash").asc_nulls_last(), "embedding").limit(k).collect()
    return np.array([[int(np.floor(1024 * x)) for x in r.embedding] for r in rows], np.int64)


def _totals(state: DataFrame, k: int, width: int) -> np.ndarray:
    """The sums of all tasks, a row per cluster: ``width`` + 3 numbers of each come to the driver."""
    parts = state.where("sums is not null").select("cluster", F.posexplode("sums").alias("pos", "part")).groupBy("cluster", "pos").agg(F.sum("part").alias("part"))
    total = np.zeros((k, width + 3), object)
    for r in parts.collect():
        total[r.cluster, r.pos] = r.part
    return total


def cluster(embeddings: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, width: int = 64) -> tuple[DataFrame, int]:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector, and the distances worked out.

    A round reads the last one's vectors and bounds from the shared folder and writes its own; the one before goes when it is
    written. What tasks return of a cluster is a row of its count and sums, so no key is shuffled that grows with the vectors; the
    driver holds ``k`` centroids of ``width`` components. Vectors of another length, with nulls or non-finite components aren't in
    the result; repeated rows count as often as they are there; with fewer vectors than ``k`` each is a centroid; an empty table
    gives an empty result. Components of over 2^17 raise an error, as distances wouldn't fit a long. Other columns aren't read.
    """
    spark = embeddings.sparkSession
    common.ship(spark)
    vectors = kept_vectors(embeddings, width)
    at, before, state, path = first_centroids(vectors, k, seed), None, vectors, None
    if not len(at):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"), 0
    scanned = 0
    for r in range(rounds + 1):
        new = common.new_path(spark, f"exponion-{r}")
        state.mapInArrow(_pass(at, before, r == rounds), STATE).write.parquet(new)
        made = spark.read.schema(STATE).parquet(new)
        total = _totals(made, len(at), width)
        scanned += sum(total[:, width + 2])
        if path:
            common.remove(spark, path)
        state, path, before = made.where("sums is null").drop("sums", "distance"), new, at
        if r < rounds:  # Python's whole-number division floors
            at = np.array([[x // n for x in sums] if n else old.tolist() for *sums, n, _, _, old in zip(*total.T, at, strict=True)], np.int64)
    apart = total[:, width + 1].tolist()
    final = [(j, d, sum(apart), hashlib.sha256(",".join(map(str, at[j].tolist())).encode()).hexdigest()) for j, d in enumerate(apart)]
    of = F.broadcast(spark.createDataFrame(final, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return made.where("sums is null").select("vec_id", "cluster", "distance").join(of, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), scanned
