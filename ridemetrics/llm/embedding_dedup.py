"""Near-duplicate vectors by cross-polytope hashing.

In each table two or more pseudo-random rotations (three rounds of sign flips
and a fast Hadamard transform) turn a vector; the signed coordinate largest in
size names its place on a cross-polytope, and the places make a bucket. A vector
lies in its own bucket and also looks into the next likely ones. Where one lies
and another lies or looks, the cosine of the two is computed in double precision.

Equal vectors count as one with their number. The more vectors there are, the
more rotations name a bucket, so that buckets stay small; further tables and
probes make up for it. Buckets of more than `block` entries are cut into blocks
that meet in pairs. A pair that meets more than once counts where its first
meeting is, which both vectors' places tell. Tasks give back sums of links and a
forest over them, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridemetrics.llm.common import NULL_ID, materialise, public_id, shuffle_width
from ridemetrics.llm.components import Forest, connected_components

#: Tables, probes and rotations per table while a table has buckets enough.
TABLES = 8
PROBES = 6
TURNS = 2
EXTRA_TABLES = 2
EXTRA_PROBES = 2
#: Vectors to a bucket beyond which a table gets a further rotation.
PER_BUCKET = 8
BLOCK = 4096
SEED = 42


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, scaled to keep lengths."""
    rows, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(rows, width // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(rows, width)
        step *= 2
    return x / np.sqrt(width)


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    signs = np.random.default_rng([SEED, seed]).choice([-1.0, 1.0], (3, x.shape[1]))
    for row in signs:
        x = hadamard(x * row)
    return x


def bucket_codes(x: np.ndarray, tables: int = TABLES, probes: int = PROBES, turns: int = TURNS) -> np.ndarray:
    """(rows, tables, probes) of bucket codes, likeliest first, of unit vectors."""
    width = padded_width(x.shape[1])
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    out = np.empty((len(x), tables, probes), np.int64)
    depth = min(4, width)
    for t in range(tables):
        code = np.zeros((len(x), 1), np.int64)
        cost = np.zeros((len(x), 1))
        for turn in range(turns * t, turns * (t + 1)):
            y = rotate(x, turn)
            top = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :depth]
            value = np.take_along_axis(y, top, axis=1)
            size = np.abs(value)
            place = 2 * top + (value < 0)
            code = (code[:, :, None] * (2 * width) + place[:, None, :]).reshape(len(x), -1)
            cost = (cost[:, :, None] + ((size[:, :1] - size) ** 2)[:, None, :]).reshape(len(x), -1)
            # Only the likeliest can be among the likeliest of more places.
            best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
            code, cost = np.take_along_axis(code, best, axis=1), np.take_along_axis(cost, best, axis=1)
        out[:, t, : code.shape[1]] = code
        out[:, t, code.shape[1] :] = out[:, t, :1]
    return out


def padded_width(dims: int) -> int:
    return 1 << max(2, (dims - 1).bit_length())


def turns_for(vectors: int, dims: int) -> int:
    """Rotations per table, so that a bucket holds a few vectors however many there are.

    A table has (2 * width) ** turns buckets; their codes have 40 bits.
    """
    places = 2 * padded_width(dims)
    turns = math.ceil(math.log(max(1, vectors) / PER_BUCKET) / math.log(places)) if vectors > PER_BUCKET else TURNS
    return min(max(TURNS, turns), int(40 // math.log2(places)))


def shape_for(vectors: int, dims: int) -> tuple[int, int, int]:
    """tables, probes and turns; each further turn takes more tables and probes to meet as surely."""
    turns = turns_for(vectors, dims)
    return TABLES + EXTRA_TABLES * (turns - TURNS), PROBES + EXTRA_PROBES * (turns - TURNS), turns


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    # Scaling first keeps squares of very large or small components finite.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _pack(kind: str):
    """vec_id, body (packed components), digest; NULLs where a vector cannot link."""
    dtype = np.dtype("<f4" if kind == "float" else "<f8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, digests = [], []
            for value in batch.column("vector"):
                body = None
                if value.is_valid and len(value.values) and not value.values.null_count:
                    x = value.values.to_numpy(zero_copy_only=False).astype(dtype) + dtype.type(0)
                    if np.isfinite(x).all() and x.any():
                        body = x.tobytes()
                bodies.append(body)
                digests.append(xxhash.xxh3_128_digest(body) if body is not None else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(bodies, pa.binary()), pa.array(digests, pa.binary())],
                ["vec_id", "body", "digest"],
            )

    return run


def _by_width(bodies: list[bytes], dtype) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors) of each vector length among the bodies."""
    sizes = np.array([len(b) for b in bodies])
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        yield at, np.frombuffer(b"".join([bodies[i] for i in at.tolist()]), dtype).reshape(len(at), -1)


def _list_meetings(dtype, shape: tuple[int, int, int]):
    """rep, bucket, rank of every bucket a vector lies in (rank 0) or looks into."""
    tables, probes, turns = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps = batch.column("rep").to_numpy()
            bodies = batch.column("body").to_pylist()
            if not bodies:
                continue
            for at, x in _by_width(bodies, dtype):
                codes = bucket_codes(unit(x), tables, probes, turns)
                bucket = codes + (np.arange(tables)[None, :, None] << 40) + (x.shape[1] << 48)
                n = tables * probes
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(reps[at], n)),
                        pa.array(bucket.reshape(-1)),
                        pa.array(np.tile(np.arange(probes), len(at) * tables)),
                    ],
                    ["rep", "bucket", "rank"],
                )

    return run


def first_meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first (table, code) at which two vectors meet, as one number; codes (pairs, tables, probes)."""
    none = np.int64(1) << 62
    best = np.full(len(a), none)
    for t in range(a.shape[1] - 1, -1, -1):
        own_a, own_b = a[:, t, 0], b[:, t, 0]
        at_a = np.where((b[:, t] == own_a[:, None]).any(axis=1), own_a, none)
        at_b = np.where((a[:, t] == own_b[:, None]).any(axis=1), own_b, none)
        code = np.minimum(at_a, at_b)
        best = np.where(code < none, code + (np.int64(t) << 40), best)
    return best


def _verifier(dtype, shape: tuple[int, int, int], least: float):
    """applyInArrow over a lot of buckets: (src, dst, n) - links of a vector, or an edge with n 0."""
    tables, probes, turns = shape

    def run(table: pa.Table) -> pa.Table:
        reps = table.column("rep").to_numpy()
        keys = [table.column(c).to_numpy() for c in ("bucket", "block_a", "block_b")]
        side = table.column("side").to_numpy()
        lies = table.column("rank").to_numpy() == 0
        times = table.column("times").to_numpy()
        bodies = table.column("body").to_pylist()
        # Each vector once, however many buckets it is in.
        seen, where = np.unique(reps, return_index=True)
        row_of = np.searchsorted(seen, reps)
        units: dict[int, np.ndarray] = {}
        width_of, place_of = np.zeros(len(seen), np.int64), np.zeros(len(seen), np.int64)
        for at, x in _by_width([bodies[i] for i in where.tolist()], dtype) if len(seen) else ():
            units[x.shape[1]] = unit(x)
            width_of[at], place_of[at] = x.shape[1], np.arange(len(at))
        # Codes of those that link only, the first time they do.
        codes = np.zeros((len(seen), tables, probes), np.int64)
        coded = np.zeros(len(seen), bool)
        weight = np.zeros(len(seen), np.int64)
        weight[row_of] = times
        links = np.zeros(len(seen), np.int64)
        forest = Forest()

        def first_here(a: np.ndarray, b: np.ndarray, bucket: int, width: int) -> np.ndarray:
            new = np.unique(np.r_[a, b])
            new = new[~coded[new]]
            if len(new):
                codes[new] = bucket_codes(units[width][place_of[new]], tables, probes, turns)
                coded[new] = True
            # The bucket's table and code, without the width of its vectors.
            return first_meeting(codes[a], codes[b]) == bucket & ((1 << 48) - 1)

        def meet(left: np.ndarray, right: np.ndarray, bucket: int) -> None:
            """Every row of `left` with every one of `right`; of the same rows with themselves, each pair once."""
            if not len(left) or not len(right):
                return
            width = int(width_of[row_of[left[0]]])
            x, y = (units[width][place_of[row_of[rows]]] for rows in (left, right))
            step = max(1, (1 << 22) // len(y))
            for at in range(0, len(x), step):
                i, j = np.nonzero(x[at : at + step] @ y.T >= least)
                i += at
                if left is right:
                    i, j = i[i < j], j[i < j]
                a, b = row_of[left[i]], row_of[right[j]]
                a, b = a[a != b], b[a != b]
                if not len(a):
                    continue
                first = first_here(a, b, bucket, width)
                a, b = a[first], b[first]
                np.add.at(links, a, weight[b])
                np.add.at(links, b, weight[a])
                forest.join(seen[a], seen[b])

        order = np.lexsort((side, *keys[::-1]))
        changed = np.zeros(len(order), bool)
        changed[:1] = True
        for key in keys:
            changed[1:] |= key[order][1:] != key[order][:-1]
        begin = np.flatnonzero(changed)
        for start, stop in zip(begin.tolist(), [*begin[1:].tolist(), len(order)]):
            own = order[start:stop]
            bucket = int(keys[0][own[0]])
            # Two that only look into a bucket do not meet there.
            lie, look = own[lies[own]], own[~lies[own]]
            if keys[1][own[0]] == keys[2][own[0]]:
                meet(lie, lie, bucket)
                meet(lie, look, bucket)
            else:
                (lie_a, lie_b), (look_a, look_b) = ([rows[side[rows] == k] for k in (0, 1)] for rows in (lie, look))
                meet(lie_a, lie_b, bucket)
                meet(lie_a, look_b, bucket)
                meet(look_a, lie_b, bucket)
        src, dst = forest.edges()
        some = np.flatnonzero(links)
        return pa.table(
            {
                "src": np.r_[seen[some], src],
                "dst": np.r_[seen[some], dst],
                "n": np.r_[links[some], np.zeros(len(src), np.int64)],
            }
        )

    return run


def embedding_dedup(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    least: float = 0.9,
    block: int = BLOCK,
) -> DataFrame:
    """One row per row of `vectors`: vec_id, n_links, component_id, kept.

    Two vectors of one length are linked if their cosine is `least` or more and
    they meet in a bucket; none below is ever linked. A vector that is NULL,
    empty or zero or holds NULL or a number that is not finite has no links. Rows
    that share an id, or have none, are vectors each, with links and a component
    of their own. A NULL id is below all others and stays NULL. An empty table
    gives no rows. How many tables, probes and rotations there are follows from
    the number of different vectors, see `shape_for`.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    dtype = np.dtype("<f4" if kind == "float" else "<f8")
    if kind not in ("float", "double"):
        vector = F.col(vector_col).cast("array<double>")
    else:
        vector = F.col(vector_col)
    rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("vec_id"), vector.alias("vector"))
    packed = materialise(rows.mapInArrow(_pack(kind), "vec_id long, body binary, digest binary"), "vectors")
    # Equal vectors are one class, under a number of its own: ids may be shared or missing.
    classes = packed.filter("digest IS NOT NULL").groupBy("digest").agg(
        F.min("vec_id").alias("least_id"), F.count("*").alias("times")
    )
    classes = materialise(classes.withColumn("rep", F.monotonically_increasing_id()), "vector-classes")
    members = packed.select("vec_id", "digest").join(classes, "digest", "left")
    single = materialise(
        packed.filter("digest IS NOT NULL")
        .select("digest", "body")
        .dropDuplicates(["digest"])
        .join(classes, "digest")
        .select("rep", "times", "body"),
        "vector-bodies",
    )
    # One number and one width decide the buckets of all.
    total, longest = single.agg(F.count("*"), F.max(F.octet_length("body"))).first()
    shape = shape_for(total, max(1, (longest or 0) // dtype.itemsize))
    meetings = materialise(
        single.select("rep", "body").mapInArrow(_list_meetings(dtype, shape), "rep long, bucket long, rank long"),
        "meetings",
    )
    large = (
        meetings.groupBy("bucket")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > block)
        .select("bucket", F.ceil(F.col("n") / block).alias("blocks"))
    )
    own = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    placed = (
        meetings.join(large, "bucket", "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
        .withColumn("own", own)
        .withColumn("other", other)
        .select(
            "rep",
            "bucket",
            "rank",
            F.least("own", "other").alias("block_a"),
            F.greatest("own", "other").alias("block_b"),
            (F.col("own") > F.col("other")).cast("long").alias("side"),
        )
    )
    lots = 4 * shuffle_width(spark)
    found = (
        placed.join(single, "rep")
        .withColumn("lot", F.pmod(F.xxhash64("bucket", "block_a", "block_b"), F.lit(lots)))
        .groupBy("lot")
        .applyInArrow(_verifier(dtype, shape, least), "src long, dst long, n long")
    )
    found = materialise(found, "vector-links")
    counts = found.filter("n > 0").groupBy(F.col("src").alias("rep")).agg(F.sum("n").alias("linked"))
    nodes = connected_components(found.filter("n = 0").select("src", "dst")).withColumnRenamed("node", "rep")
    nodes = materialise(nodes.join(classes.select("rep", "least_id"), "rep"), "vector-nodes")
    names = nodes.groupBy("component").agg(F.min("least_id").alias("reached"))
    nodes = nodes.join(names, "component").select("rep", "reached")
    done = members.join(counts, "rep", "left").join(nodes, "rep", "left")
    component = F.coalesce("reached", "least_id", "vec_id")
    return done.select(
        public_id("vec_id"),
        (F.coalesce(F.col("times") - 1, F.lit(0)) + F.coalesce("linked", F.lit(0))).alias("n_links"),
        F.when(component != NULL_ID, component).alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )
