"""Centroid clustering of vectors with ns-bounds.

Each vector keeps, for every centroid, a lower bound of its distance and the
round in which that distance was last worked out. All earlier centroids are
retained, so a bound is loosened by how far the centroid is now from where it was then
(the norm of the total displacement), which is never more than the sum of its moves.
A centroid whose loosened bound does not exceed the distance to the vector's own
is worked out again exactly; the others cannot be nearest.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactmill.session import shared_dir

SCALE = 256
# Integer components up to this size keep all squared distances within a long.
LARGEST = 1 << 27
# Up to this size products and their sums are exact in doubles, too.
EXACT_IN_DOUBLES = 1 << 20
# Doubles carry a relative error of about 1e-16; bounds are moved apart by far more.
SLACK = 1e-12
BLOCK = 4096


def as_integers(vectors: np.ndarray) -> np.ndarray:
    """Components as ``floor(256 * x)``; exact, as 256 is a power of two."""
    scaled = np.floor(vectors * SCALE)
    if scaled.size and np.abs(scaled).max() > LARGEST:
        raise ValueError(f"components beyond {LARGEST // SCALE} have distances that do not fit into a long")
    return scaled.astype(np.int64)


def squared_distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of every point to every centroid."""
    largest = max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0))
    kind = np.float64 if largest <= EXACT_IN_DOUBLES else np.int64
    p, c = points.astype(kind), centroids.astype(kind)
    return ((p * p).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (p @ c.T)).astype(np.int64)


def below(squared: np.ndarray) -> np.ndarray:
    """Distances rounded down to single precision, as lower bounds."""
    root = np.sqrt(squared.astype(np.float64)) * (1 - SLACK)
    low = root.astype(np.float32)
    return np.where(low > root, np.nextafter(low, np.float32(-np.inf)), low)


def moved(history: list[np.ndarray]) -> np.ndarray:
    """By round and centroid, how far the centroid is now from where it was, rounded up."""
    now = history[-1].astype(np.float64)
    return np.array([np.sqrt(((now - then) ** 2).sum(1)) * (1 + SLACK) for then in history])


def first_assignment(points: np.ndarray, centroids: np.ndarray) -> tuple:
    squared = squared_distances(points, centroids)
    cluster = squared.argmin(1)
    return cluster, squared[np.arange(len(points)), cluster], below(squared), np.zeros(squared.shape, np.uint8)


def next_assignment(points: np.ndarray, cluster: np.ndarray, low: np.ndarray, seen: np.ndarray, history: list[np.ndarray]) -> tuple[tuple, int]:
    """The nearest centroid of each point and its new bounds, and how many distances were worked out."""
    centroids, drift = history[-1], moved(history)
    n, k = low.shape
    rows, every = np.arange(n), np.arange(k)
    own = ((points - centroids[cluster]) ** 2).sum(1)
    reach = np.sqrt(own.astype(np.float64)) * (1 + SLACK)
    # A tie goes to the smaller number, so a bound that only equals the own distance fails as well.
    failed = low.astype(np.float64) * (1 - SLACK) - drift[seen, every[None, :]] <= reach[:, None]
    failed[rows, cluster] = False
    squared = np.full((n, k), np.iinfo(np.int64).max)
    squared[rows, cluster] = own
    for j in np.flatnonzero(failed.any(0)):
        at = np.flatnonzero(failed[:, j])
        squared[at, j] = ((points[at] - centroids[j]) ** 2).sum(1)
    worked = failed.copy()
    worked[rows, cluster] = True
    low = np.where(worked, below(np.where(worked, squared, 0)), low)
    seen = np.where(worked, np.uint8(len(history) - 1), seen)
    nearest = squared.argmin(1)
    return (nearest, squared[rows, nearest], low, seen), int(worked.sum())


STATE = "cluster int, distance bigint, points binary, low binary, seen binary"


def _binary(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values, without a Python object for each."""
    width = rows.shape[1] * rows.dtype.itemsize if len(rows) else 0
    data = pa.py_buffer(np.ascontiguousarray(rows).tobytes())
    offsets = pa.py_buffer((np.arange(len(rows) + 1, dtype=np.int32) * width).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, data])


def _matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _row_batch(ids: pa.Array, points, cluster, distance, low, seen) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(cluster.astype(np.int32)), pa.array(distance), _binary(points), _binary(low), _binary(seen)],
        names=["id", "cluster", "distance", "points", "low", "seen"],
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield batch.slice(at, BLOCK)


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, seed: int = 2) -> DataFrame:
    """``id, cluster, distance, cluster_inertia, inertia, centroid``: Lloyd's rounds over integer vectors, exactly.

    General: no record of the contact model holds a vector. ``vectors`` has ``id`` (a whole number) and ``vector``; rows whose
    vector is null, has not ``dims`` components, or holds a null or non-finite one are left out. A component
    x counts as floor(256 x); beyond 524,288 it is an error, since squared distances would not fit into a long. The first
    centroids are the ``k`` vectors (all, if fewer) with the smallest SHA-256 of ``<seed>:<id>``, in that order (null ids
    last; ties by the vector). Each round gives every vector to its nearest centroid (ties: smaller number) and
    moves every centroid with vectors to the floor of their mean; then all are given once more.

    ``distance`` is squared, ``cluster_inertia`` and ``inertia`` are its sums. Repeated rows count each; an empty table gives no
    rows; other columns are ignored. Vectors are never shuffled: per round, each task adds up its vectors, and ``k * dims`` sums
    reach the driver. A round's rows are a table in the shared folder and replace those of the round before.
    """
    if rounds > 250:
        raise ValueError("rounds are kept in one byte")
    spark = vectors.sparkSession
    id_type = next(f.dataType for f in vectors.schema if f.name == "id").simpleString()
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select("id", F.col("vector").cast("array<double>").alias("vector")).where(
        (F.size("vector") == dims) & F.coalesce(finite, F.lit(False))
    )
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    starts = kept.orderBy(rank.asc_nulls_last(), "vector").limit(k).select("vector").collect()
    table = f"id {id_type}, {STATE}"
    if not starts:
        out = "cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid array<bigint>"
        return spark.createDataFrame([], f"id {id_type}, {out}")
    history = [as_integers(np.array([r["vector"] for r in starts], np.float64))]
    width = len(starts)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches):
            column = batch.column(1)
            points = as_integers(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
            yield _row_batch(batch.column(0), points.astype("<i4"), *first_assignment(points, history[0]))

    def assign(centroids: list[np.ndarray]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _cut(batches):
                points = _matrix(batch.column(3), "<i4", dims).astype(np.int64)
                cluster = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                low, seen = _matrix(batch.column(4), "<f4", width), _matrix(batch.column(5), np.uint8, width)
                found, _ = next_assignment(points, cluster, low, seen, centroids)
                yield _row_batch(batch.column(0), points.astype("<i4"), *found)

        return run

    state = _write(kept.mapInArrow(begin, table), table)
    for _ in range(rounds):
        history.append(_centroids(state[0], history[-1], dims))
        before, state = state, _write(state[0].mapInArrow(assign(list(history)), table), table)
        _drop(spark, before[1])
    given = state[0].select("id", "cluster", "distance")
    model = spark.createDataFrame([(j, [int(x) for x in c]) for j, c in enumerate(history[-1])], "cluster int, centroid array<bigint>")
    sums = given.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    sums = sums.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy()))  # k rows
    return given.join(F.broadcast(sums.join(F.broadcast(model), "cluster")), "cluster").select(
        "id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"
    )


def _centroids(state: DataFrame, before: np.ndarray, dims: int) -> np.ndarray:
    """The floors of the means; a centroid without vectors stays."""
    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((len(before), dims), np.int64), np.zeros(len(before), np.int64)
        for batch in _cut(batches):
            cluster = batch.column(0).to_numpy(zero_copy_only=False)
            np.add.at(sums, cluster, _matrix(batch.column(1), "<i4", dims))
            counts += np.bincount(cluster, minlength=len(before))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(counts[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"]
        )

    parts = state.select("cluster", "points").mapInArrow(add_up, "cluster int, n bigint, sums array<bigint>")
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    totals = parts.select("cluster", "n", F.posexplode("sums").alias("at", "x")).groupBy("cluster", "at").agg(whole("n"), whole("x"))
    after = before.copy()
    for row in totals.collect():
        after[row["cluster"], row["at"]] = int(row["x"]) // int(row["n"])
    return after


def _write(df: DataFrame, schema: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/contactmill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path), path


def _drop(spark, path: str) -> None:
    """Remove a table of an earlier round, written here, that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
