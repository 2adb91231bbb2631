"""Winnowed anchors: where two documents can share a long passage.

Of every window of positions the one with the least hash is an anchor (the
leftmost of equals), so two equal windows have the same anchor at the same place
in them. Only anchors whose hash occurs more than once in the corpus can lie in
a repeated window; the others never leave the first step.

What a Python task has of one hash it combines before the shuffle: a hash that
occurs twice within a slice of documents is known to repeat, its places are
passed on at once, and the bucket gets one entry for all of them. A hash in a
third of all documents is one entry per slice.

Rows carry packed arrays: `bucket` says where a row goes, `kind` what it holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridemetrics.llm.common import run_starts, shuffle_width, unpack, utf8_slices

#: kind of a row: places still to be judged, or places known to repeat.
OPEN, KNOWN = 0, 1

PLACE_SCHEMA = "bucket long, kind long, hashes binary, ids binary, places binary"
REQUEST_SCHEMA = "bucket long, ids binary, places binary"


def winnow(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of one sequence: position, first window and number of windows.

    Window i is hashes[i : i + width]; consecutive windows with one anchor are
    given together.
    """
    if len(hashes) < width:
        none = np.zeros(0, np.int64)
        return none, none, none
    # The leftmost least of each window, by doubling windows that overlap.
    least, owner, have = hashes, np.arange(len(hashes), dtype=np.int32), 1
    while have < width:
        step = min(have, width - have)
        left, right = least[:-step], least[step:]
        lower = right < left
        owner = np.where(lower, owner[step:], owner[:-step])
        least = np.minimum(left, right)
        have += step
    count = len(owner)
    first = run_starts(owner)
    return owner[first], first, np.diff(np.r_[first, count])


def bucket_count(spark: SparkSession) -> int:
    """A prime, about two buckets per shuffle partition.

    A bucket gives back one row per bucket it has something for, so rows grow with
    the square of this number, whatever the data.
    """
    n = 2 * shuffle_width(spark) | 1
    while any(n % d == 0 for d in range(3, int(n**0.5) + 1, 2)):
        n += 2
    return n


def bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a document; by_bucket computes the same in Spark."""
    folded = ids ^ (ids.view(np.uint64) >> np.uint64(29)).view(np.int64)
    return folded % buckets


def by_bucket(rows: DataFrame, buckets: int) -> DataFrame:
    folded = F.col("doc_id").bitwiseXOR(F.shiftrightunsigned("doc_id", 29))
    return rows.withColumn("bucket", F.pmod(folded, F.lit(buckets)))


def split_rows(keys: np.ndarray, *arrays: np.ndarray):
    """(key, arrays of that key) for each key, order kept within it."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = run_starts(keys)
    stops = np.r_[starts[1:], len(keys)]
    arrays = tuple(a[order] for a in arrays)
    for a, b in zip(starts.tolist(), stops.tolist()):
        yield int(keys[a]), tuple(x[a:b] for x in arrays)


def place_lister(find: Callable, buckets: int):
    """mapInArrow over keyed documents; `find` gives (hash, row, place) of a slice's anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in utf8_slices(batches):
            hashes, rows, places = find(batch.column("text"))
            ids = batch.column("doc_id").to_numpy()[rows]
            out: list[tuple] = []
            order = np.argsort(hashes, kind="stable")
            hashes, ids, places = hashes[order], ids[order], places.astype(np.int64)[order]
            starts = run_starts(hashes)
            counts = np.diff(np.r_[starts, len(hashes)])
            several = np.repeat(counts > 1, counts)
            # Hashes met once: where they are. Hashes met again: that they are.
            lone = starts[counts == 1]
            more = starts[counts > 1]
            entry_hash = np.r_[hashes[lone], hashes[more]]
            entry_id = np.r_[ids[lone], ids[more]]
            entry_place = np.r_[places[lone], np.full(len(more), -1)]
            goes = (entry_hash % np.uint64(buckets)).astype(np.int64)
            for bucket, (h, i, p) in split_rows(goes, entry_hash, entry_id, entry_place):
                out.append((bucket, OPEN, h.tobytes(), i.tobytes(), p.astype(np.int32).tobytes()))
            known_ids, known_places = ids[several], places[several]
            for bucket, (i, p) in split_rows(bucket_of(known_ids, buckets), known_ids, known_places):
                out.append((bucket, KNOWN, b"", i.tobytes(), p.astype(np.int32).tobytes()))
            if out:
                columns = list(zip(*out))
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)],
                    ["bucket", "kind", "hashes", "ids", "places"],
                )

    return run


def repeat_finder(buckets: int):
    """applyInArrow over one bucket: requests (bucket of the document, ids, places)."""

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        blobs = {c: table.column(c).to_pylist() for c in ("hashes", "ids", "places")}
        open_rows = np.flatnonzero(kind == OPEN).tolist()
        hashes = unpack([blobs["hashes"][i] for i in open_rows], np.uint64)
        ids = unpack([blobs["ids"][i] for i in open_rows], np.int64)
        places = unpack([blobs["places"][i] for i in open_rows], np.int32)
        order = np.argsort(hashes, kind="stable")
        counts = np.diff(np.r_[run_starts(hashes[order]), len(hashes)])
        again = np.zeros(len(hashes), bool)
        again[order] = np.repeat(counts > 1, counts)
        again &= places >= 0
        known = np.flatnonzero(kind == KNOWN).tolist()
        ids = np.r_[ids[again], unpack([blobs["ids"][i] for i in known], np.int64)]
        places = np.r_[places[again], unpack([blobs["places"][i] for i in known], np.int32)]
        out = [
            (bucket, i.tobytes(), p.tobytes())
            for bucket, (i, p) in split_rows(bucket_of(ids, buckets), ids, places)
        ]
        columns = list(zip(*out)) if out else [[], [], []]
        return pa.table(
            {
                "bucket": pa.array(columns[0], pa.int64()),
                "ids": pa.array(columns[1], pa.binary()),
                "places": pa.array(columns[2], pa.binary()),
            }
        )

    return run


def repeated_places(rows: DataFrame, find: Callable, buckets: int) -> DataFrame:
    """Requests for the anchors of `rows` (doc_id, text) whose hash occurs more than once."""
    return (
        rows.select("doc_id", "text")
        .mapInArrow(place_lister(find, buckets), PLACE_SCHEMA)
        .groupBy("bucket")
        .applyInArrow(repeat_finder(buckets), REQUEST_SCHEMA)
    )


def wanted_places(table: pa.Table) -> dict[int, np.ndarray]:
    """Places by document of the requests of one bucket."""
    ids = unpack(table.column("ids").to_pylist(), np.int64)
    places = unpack(table.column("places").to_pylist(), np.int32)
    return {key: np.unique(p) for key, (p,) in split_rows(ids, places)}
