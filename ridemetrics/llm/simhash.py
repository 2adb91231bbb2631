"""SimHash near-duplicates found with vantage-point trees.

Two fingerprints of 64 bits that differ in 3 bits or fewer have a half of 32
bits in which they differ in 1 or none, so each half is searched with radius 1
and what is found is checked on all 64. Distances of a half are Hamming
distances, so the triangle bound prunes: a fingerprint at distance d from a
vantage point can have partners inside its sphere only if d <= radius of the
sphere + 1, outside only if d > radius - 1.

The top of each tree is grown on a bounded sample and its leaves are shards.
Every distinct fingerprint lies in one shard and visits the later shards whose
boundary it overlaps. Shards with very many fingerprints are cut into blocks
that meet in pairs. Inside a task the tree goes on down to small leaves. Tasks
give back a forest over the links they find, not the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridemetrics.llm.common import keyed, materialise, numbered_rows, public_id
from ridemetrics.llm.components import Forest, connected_components

SHINGLE_WORDS = 3
HASH_SEED = 42
MOST_BITS = 3
#: Fingerprints of the sample that the top of the trees is grown on.
SAMPLE = 16_384
#: Fingerprints aimed at per shard, and leaf size inside a task.
SHARD = 16_384
LEAF = 512


def fingerprint(text: str, words_each: int = SHINGLE_WORDS, seed: int = HASH_SEED) -> int:
    """64 bits; bit set if set in over half of the hashes of the word shingles."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= words_each:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.r_[0, ends[:-1]]
        digest = xxhash.xxh64_intdigest
        spans = zip(starts[: len(words) - words_each + 1].tolist(), (ends[words_each - 1 :] - 1).tolist())
        hashes = [digest(joined[a:b], seed) for a, b in spans]
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], np.uint64)
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    bits = (2 * total > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter(
            (fingerprint(t.as_py()) for t in batch.column("text")), np.uint64, batch.num_rows
        )
        others = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays(
            [*map(batch.column, others), pa.array(found.view(np.int64))], [*others, "fp"]
        )


def half(fps: np.ndarray, which: int) -> np.ndarray:
    return (fps >> np.uint64(32 * which)).astype(np.uint32)


def _distance(values: np.ndarray, point: int) -> np.ndarray:
    return np.bitwise_count(values ^ np.uint32(point))


def choose_vantage(values: np.ndarray) -> tuple[int, int] | None:
    """A vantage point that spreads `values` well, and the radius that halves them."""
    best = None
    for i in np.linspace(0, len(values) - 1, 8).astype(int):
        away = _distance(values, values[i])
        radius = int(np.median(away))
        inside = int((away <= radius).sum())
        if inside == len(values):
            radius = int(away.max()) - 1
            inside = int((away <= radius).sum())
        if radius < 0 or not 0 < inside < len(values):
            continue
        near = int((np.abs(away.astype(int) - radius) <= 1).sum())
        score = (near + abs(2 * inside - len(values)), int(values[i]), radius)
        if best is None or score < best:
            best = score
    return None if best is None else (best[1], best[2])


def grow_top(values: np.ndarray, leaves: int) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage, radius, inside, outside); a negative child -k-1 is leaf k."""
    nodes: list[tuple[int, int, int, int]] = []
    count = 0

    def grow(part: np.ndarray, want: int) -> int:
        nonlocal count
        pick = choose_vantage(part) if want > 1 and len(part) > 16 else None
        if pick is None:
            count += 1
            return -count
        at = len(nodes)
        nodes.append((0, 0, 0, 0))
        away = _distance(part, pick[0])
        inside = grow(part[away <= pick[1]], want // 2)
        outside = grow(part[away > pick[1]], want - want // 2)
        nodes[at] = (pick[0], pick[1], inside, outside)
        return at

    root = grow(values, leaves)
    return nodes if root >= 0 else []


def visits(values: np.ndarray, nodes: list, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home leaf of each value; then the (row, leaf) of later leaves it overlaps."""
    home = np.zeros(len(values), np.int64)
    rows: list[np.ndarray] = []
    leaves: list[np.ndarray] = []
    todo = [(0 if nodes else -1, np.arange(len(values)), np.ones(len(values), bool))]
    while todo:
        at, idx, own = todo.pop()
        if not len(idx):
            continue
        if at < 0:
            home[idx[own]] = -at - 1
            rows.append(idx[~own])
            leaves.append(np.full(int((~own).sum()), -at - 1))
            continue
        vantage, radius, inside, outside = nodes[at]
        away = _distance(values[idx], vantage).astype(np.int64)
        near = away <= radius + reach
        far = away > radius - reach
        todo.append((inside, idx[near], own[near] & (away[near] <= radius)))
        todo.append((outside, idx[far], own[far] & (away[far] > radius)))
    row, leaf = np.concatenate(rows), np.concatenate(leaves)
    later = leaf > home[row]
    return home, row[later], leaf[later]


def _router(tops: list[list], sizes: list[dict[int, int]] | None, reach: int, shard: int):
    """Rows (half, leaf, block_a, block_b, role, fp); role 0 lies there, 1 visits.

    Without sizes only the home leaves are given, to be counted.
    """

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            if not len(fps):
                continue
            for which, nodes in enumerate(tops):
                home, row, leaf = visits(half(fps, which), nodes, reach)
                rows = np.r_[np.arange(len(fps)), row]
                leaves = np.r_[home, leaf]
                role = np.r_[np.zeros(len(fps), np.int64), np.ones(len(row), np.int64)]
                if sizes is None:
                    parts = [(rows[role == 0], leaves[role == 0], 0, 0, role[role == 0])]
                else:
                    # Blocks of a large leaf meet in pairs; a visitor meets each once.
                    most = max(sizes[which], default=0) + 1
                    blocks = np.ones(max(most, int(leaves.max()) + 1), np.int64)
                    for k, n in sizes[which].items():
                        blocks[k] = max(1, -(-n // (2 * shard)))
                    many = blocks[leaves]
                    own = (fps[rows] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % many
                    parts = []
                    for b in range(int(many.max())):
                        use = many > b
                        lies, r, o = role[use] == 0, rows[use], own[use]
                        first = np.where(lies, np.minimum(o, b), b)
                        second = np.where(lies, np.maximum(o, b), b)
                        parts.append((r, leaves[use], first, second, role[use]))
                for r, k, a, b, what in parts:
                    n = len(r)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(n, which, np.int64)),
                            pa.array(k),
                            pa.array(np.broadcast_to(a, n).astype(np.int64)),
                            pa.array(np.broadcast_to(b, n).astype(np.int64)),
                            pa.array(what),
                            pa.array(fps[r].view(np.int64)),
                        ],
                        ["half", "leaf", "block_a", "block_b", "role", "fp"],
                    )

    return route


def search(
    which: int, lying: np.ndarray, asking: np.ndarray, reach: int, most_bits: int, forest: Forest
) -> None:
    """Join in `forest` all of lying x lying and asking x lying within `most_bits`."""
    todo = [(lying, lying), (lying, asking)]
    while todo:
        points, queries = todo.pop()
        if not len(points) or not len(queries):
            continue
        pick = choose_vantage(half(points, which)) if len(points) > LEAF else None
        if pick is None:
            for at in range(0, len(points), 1 << 14):
                block = points[at : at + (1 << 14)]
                step = max(1, (1 << 20) // len(block))
                for q in range(0, len(queries), step):
                    bits = np.bitwise_count(queries[q : q + step, None] ^ block[None, :])
                    left, right = np.nonzero(bits <= most_bits)
                    a, b = queries[q + left].view(np.int64), block[right].view(np.int64)
                    apart = a != b
                    forest.join(a[apart], b[apart])
            continue
        vantage, radius = pick
        near = _distance(half(points, which), vantage) <= radius
        away = _distance(half(queries, which), vantage).astype(np.int64)
        todo.append((points[near], queries[away <= radius + reach]))
        todo.append((points[~near], queries[away > radius - reach]))


def _searcher(reach: int, most_bits: int):
    def run(table: pa.Table) -> pa.Table:
        fps = table.column("fp").to_numpy().view(np.uint64)
        role = table.column("role").to_numpy()
        which = table.column("half")[0].as_py() if len(fps) else 0
        forest = Forest()
        search(which, np.unique(fps[role == 0]), np.unique(fps[role == 1]), reach, most_bits, forest)
        src, dst = forest.edges()
        return pa.table({"src": src, "dst": dst})

    return run


def near_fingerprints(
    fps: DataFrame, most_bits: int = MOST_BITS, sample: int = SAMPLE, shard: int = SHARD
) -> DataFrame:
    """Edges (src, dst) that connect what lies within `most_bits`, of distinct longs fp."""
    reach = most_bits // 2
    total = fps.count()
    leaves = min(sample // 16, max(1, -(-total // shard)))
    picked = fps.orderBy(F.xxhash64("fp"), "fp").limit(sample) if leaves > 1 else fps.limit(0)
    known = np.array([r.fp for r in picked.collect()], np.int64).view(np.uint64)
    tops = [grow_top(half(known, which), leaves) if len(known) else [] for which in (0, 1)]
    schema = "half long, leaf long, block_a long, block_b long, role long, fp long"
    sizes = None
    counted: list[dict[int, int]] = [{}, {}]
    homes = fps.mapInArrow(_router(tops, sizes, reach, shard), schema)
    # At most sample / 8 rows, one per leaf.
    for row in homes.groupBy("half", "leaf").count().collect():
        counted[row["half"]][row["leaf"]] = row["count"]
    return (
        fps.mapInArrow(_router(tops, counted, reach, shard), schema)
        .groupBy("half", "leaf", "block_a", "block_b")
        .applyInArrow(_searcher(reach, most_bits), "src long, dst long")
    )


def _grouped(prints: DataFrame, rank: str, most_bits: int) -> DataFrame:
    """fp, component, and the least `rank` of each distinct fp of `prints`."""
    classes = materialise(prints.groupBy("fp").agg(F.min(rank).alias("least")), "simhash-classes")
    nodes = connected_components(near_fingerprints(classes.select("fp"), most_bits))
    return classes.join(nodes, classes["fp"] == nodes["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MOST_BITS
) -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint, component_id.

    Words are what stands between white space, lower-cased in A-Z; shingles are 3
    words, or all there are. NULL, empty and blank texts have fingerprint zero
    and link like any other. component_id is the smallest id reachable over
    links of `most_bits` or fewer; a NULL id is below all others and stays NULL,
    as its component's id too. Repeated rows come out once each.
    """
    rows = keyed(docs, id_col, text_col).select("doc_id", "text")
    prints = materialise(rows.mapInArrow(_fingerprints, "doc_id long, fp long"), "simhash")
    grouped = _grouped(prints, "doc_id", most_bits)
    firsts = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = grouped.join(firsts, "component").select("fp", "component_id")
    return prints.join(named, "fp").select(
        public_id(), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), public_id("component_id")
    )


def first_of_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MOST_BITS
) -> DataFrame:
    """One row of `docs` for each component, that with the smallest id; columns as they are.

    Of rows that share the id, and of rows without one, the hash of the text decides,
    of equal rows one stays.
    """
    marked, row = numbered_rows(docs, "near-rows")
    rows = keyed(marked, id_col, text_col, row).select("doc_id", "row_hash", F.col(row).alias("row"), "text")
    schema = "doc_id long, row_hash long, row long, fp long"
    prints = materialise(
        rows.mapInArrow(_fingerprints, schema).select("fp", F.struct("doc_id", "row_hash", "row").alias("rank")),
        "simhash",
    )
    grouped = _grouped(prints, "rank", most_bits)
    firsts = grouped.groupBy("component").agg(F.min("least").alias("least")).select(F.col("least.row").alias(row))
    return marked.join(firsts, row, "left_semi").select(*docs.columns)
