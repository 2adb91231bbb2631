"""Centroid clustering by Lloyd's rounds over column blocks.

Vectors are cut twice: into chunks of rows, and each chunk into blocks of
`block_dims` components. A block of a chunk is one row, and no task needs a whole
vector. In a round each block gives the exact partial distances of its rows to
the centroids' slices of that block; the blocks of a chunk are added and the
nearest centroid taken; the labels go back to the blocks, and each block's shard
makes the new slice of every centroid from its own columns. What a round moves
is one partial distance per row, centroid and block, and the labels; the
blocks themselves stay where they are, in a table bucketed by block and chunk.

All arithmetic is in whole numbers, so results do not depend on the order of sums.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridemetrics.llm.common import NULL_ID, materialise, public_id, shuffle_width
from ridemetrics.session import scratch_dir

DIMS = 64
CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
BLOCK_DIMS = 16
#: Rows of a chunk, and partial distances that a block gives at once.
CHUNK_ROWS = 4096
CHUNK_DISTANCES = 1 << 18
#: Scaled components lie within this, so that squared distances fit 64 bits.
LARGEST = 1 << 27


def scaled(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as integers; ValueError where distances could overflow."""
    x = np.floor(values.astype(np.float64) * scale)
    if len(x) and np.abs(x).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST // scale}; its distances do not fit 64 bits")
    return x.astype(np.int32)


def _usable(vector: Column, dims: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) == dims) & finite, F.lit(False))


def _cut(dims: int, block_dims: int, chunk_rows: int, scale: int):
    """block, chunk, cells (rows x columns), and the ids of the rows with block 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, chunk_rows):
                part = batch.slice(at, chunk_rows)
                x = scaled(part.column("vector").flatten().to_numpy(zero_copy_only=False), scale).reshape(-1, dims)
                ids = part.column("vec_id").to_numpy().astype(np.int64)
                cells = [np.ascontiguousarray(x[:, b : b + block_dims]).tobytes() for b in range(0, dims, block_dims)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(len(cells))),
                        pa.array(np.full(len(cells), chunk)),
                        pa.array(cells, pa.binary()),
                        pa.array([ids.tobytes()] + [None] * (len(cells) - 1), pa.binary()),
                    ],
                    ["block", "chunk", "cells", "ids"],
                )
                chunk += 1

    return run


def _cells(body: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(body, np.int32).reshape(-1, columns).astype(np.int64)


def _partial_distances(centroids: np.ndarray, block_dims: int):
    """chunk, partial: squared distances of a block's rows to each centroid's slice."""
    count = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, chunk, body in zip(*(batch.column(c).to_pylist() for c in ("block", "chunk", "cells"))):
                piece = centroids[:, block * block_dims : (block + 1) * block_dims]
                x = _cells(body, piece.shape[1])
                out = np.empty((len(x), count), np.int64)
                for k in range(count):
                    apart = x - piece[k]
                    out[:, k] = np.einsum("ij,ij->i", apart, apart)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk], pa.int64()), pa.array([out.tobytes()], pa.binary())], ["chunk", "partial"]
                )

    return run


def _nearest(count: int):
    """applyInArrow over the blocks of a chunk: chunk, labels, distances."""

    def run(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(body, np.int64) for body in table.column("partial").to_pylist())
        total = total.reshape(-1, count)
        labels = total.argmin(axis=1)
        return pa.table(
            {
                "chunk": table.column("chunk").slice(0, 1),
                "labels": pa.array([labels.astype(np.int32).tobytes()], pa.binary()),
                "distances": pa.array([total[np.arange(len(total)), labels].tobytes()], pa.binary()),
            }
        )

    return run


def _block_sums(count: int, dims: int, block_dims: int):
    """block, cluster, n, sums: what a task adds up of its blocks' columns, per cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        members: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, body, labels in zip(*(batch.column(c).to_pylist() for c in ("block", "cells", "labels"))):
                columns = min(block_dims, dims - block * block_dims)
                x, own = _cells(body, columns), np.frombuffer(labels, np.int32)
                if block not in sums:
                    sums[block] = np.zeros((count, columns), np.int64)
                    members[block] = np.zeros(count, np.int64)
                np.add.at(sums[block], own, x)
                members[block] += np.bincount(own, minlength=count)
        rows = [(b, k, int(members[b][k]), sums[b][k].tolist()) for b in sums for k in range(count) if members[b][k]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.int64()),
                pa.array([r[3] for r in rows], pa.list_(pa.int64())),
            ],
            ["block", "cluster", "n", "sums"],
        )

    return run


def _new_slice(table: pa.Table) -> pa.Table:
    """applyInArrow over one block's sums: its slice of each centroid that has members."""
    clusters = table.column("cluster").to_numpy()
    n = table.column("n").to_numpy()
    # Python's integers: sums over all tasks may pass 64 bits.
    sums = np.array(table.column("sums").to_pylist(), object).reshape(len(n), -1)
    some = np.unique(clusters)
    slices = [(sums[clusters == k].sum(axis=0) // int(n[clusters == k].sum())).tolist() for k in some.tolist()]
    block = table.column("block")[0].as_py()
    return pa.table(
        {
            "block": pa.array([block] * len(some), pa.int64()),
            "cluster": pa.array(some),
            "slice": pa.array(slices, pa.list_(pa.int64())),
        }
    )


def _label_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, labels, distances in zip(*(batch.column(c).to_pylist() for c in ("ids", "labels", "distances"))):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.frombuffer(ids, np.int64)),
                    pa.array(np.frombuffer(labels, np.int32)),
                    pa.array(np.frombuffer(distances, np.int64)),
                ],
                ["vec_id", "cluster", "distance"],
            )


def lloyd_clusters(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    dims: int = DIMS,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    block_dims: int = BLOCK_DIMS,
) -> DataFrame:
    """One row per usable vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Usable vectors have `dims` components, none NULL or non-finite; others get no
    row. Components become floor(scale * x). The first centroids are the vectors
    with the smallest SHA-256 of `3:<vec_id>` (a NULL id: of `3:`), rows that
    share an id ordered by their components; with fewer vectors than `clusters`
    there are as many centroids as vectors. Repeated rows count each, a NULL id
    stays NULL. Of equally near centroids the smaller number wins; a cluster
    without members keeps its centroid. A scaled component beyond 2**27 is an
    error, since distances would not fit 64 bits. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    vector = F.col(vector_col).cast("array<double>")
    vec_id = F.col(id_col).cast("long")
    usable = vectors.select(vec_id.alias("vec_id"), vector.alias("vector")).filter(_usable(F.col("vector"), dims))
    # `clusters` vectors reach the driver, and after each round `clusters` centroids.
    seed = F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = usable.orderBy(seed, "vector").limit(clusters).select("vector").collect()
    centroids = scaled(np.array([row[0] for row in first], np.float64).reshape(-1, dims), scale).astype(np.int64)
    count = max(1, len(centroids))

    chunk_rows = max(1, min(CHUNK_ROWS, CHUNK_DISTANCES // count))
    rows = usable.select(F.coalesce("vec_id", F.lit(NULL_ID)).alias("vec_id"), "vector")
    cut = rows.mapInArrow(_cut(dims, block_dims, chunk_rows, scale), "block long, chunk long, cells binary, ids binary")
    blocks, table = _bucketed(cut, "block", "chunk")
    ids = materialise(blocks.filter("block = 0").select("chunk", "ids"), "lloyd-ids")
    every_block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(-(-dims // block_dims) - 1).cast("long")))

    def assigned() -> DataFrame:
        partial = blocks.select("block", "chunk", "cells").mapInArrow(
            _partial_distances(centroids, block_dims), "chunk long, partial binary"
        )
        near = partial.groupBy("chunk").applyInArrow(
            _nearest(count), "chunk long, labels binary, distances binary"
        )
        return materialise(near, "lloyd-labels")

    for _ in range(rounds if len(centroids) else 0):
        # The labels of a chunk go to each of its blocks, whose number is fixed.
        sent = assigned().select(every_block.alias("block"), "chunk", "labels")
        sums = (
            blocks.select("block", "chunk", "cells")
            .join(sent.hint("shuffle_merge"), ["block", "chunk"])
            .mapInArrow(_block_sums(count, dims, block_dims), "block long, cluster long, n long, sums array<long>")
        )
        slices = sums.groupBy("block").applyInArrow(_new_slice, "block long, cluster long, slice array<long>")
        centroids = centroids.copy()
        for block, cluster, piece in slices.collect():
            centroids[cluster, block * block_dims : block * block_dims + len(piece)] = piece

    labelled = ids.join(assigned(), "chunk").mapInArrow(_label_rows, "vec_id long, cluster int, distance long")
    labelled = materialise(labelled, "lloyd-rows")
    sums = dict(labelled.groupBy("cluster").agg(F.sum("distance")).collect())
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    facts = [
        (k, sums[k], sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[k].tolist())).encode()).hexdigest())
        for k in sorted(sums)
    ]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # One row per cluster.
    return labelled.join(F.broadcast(facts), "cluster").select(
        public_id("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _bucketed(df: DataFrame, *keys: str) -> tuple[DataFrame, str]:
    """`df` written to the shared folder in one bucket per shuffle partition, and the table's name."""
    spark = df.sparkSession
    width = shuffle_width(spark)
    name = f"lloyd_{uuid.uuid4().hex}"
    (
        df.repartition(width, *keys)
        .write.bucketBy(width, *keys)
        .sortBy(*keys)
        .option("path", scratch_dir(spark, "lloyd-blocks"))
        .saveAsTable(name)
    )
    return spark.table(name), name
