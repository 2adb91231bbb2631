"""Removal of long byte strings that occur earlier, by suffix sorting.

A byte string of `length` bytes that repeats has the same winnowed anchor
wherever it occurs, so shards are made by anchor: for every anchor that repeats,
the stretch of text whose windows it is the anchor of goes to its shard. Equal
stretches are one entry there, with the earliest place; the others are repeats.
Stretches that differ are sorted: suffix and common-prefix arrays of the shard
(suffix_array.py) put equal windows next to each other, and all but the earliest
are repeats. What a task knows of equal stretches it settles before the shuffle.

Four shuffles: packed hashes, packed places, stretches, repeats; texts are
shuffled once by document and that exchange is used twice.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from ridemetrics.llm.anchors import (
    KNOWN,
    OPEN,
    bucket_count,
    bucket_of,
    by_bucket,
    repeated_places,
    split_rows,
    wanted_places,
    winnow,
)
from ridemetrics.llm.common import joined_utf8, keyed, mix64, public_spread_id, run_starts, spread_nulls, unpack
from ridemetrics.llm.suffix_array import QUEUE_MEMORY, sorted_suffixes

LENGTH = 100
#: Bytes hashed for an anchor; windows of `length` hold length - GRAM + 1 of them.
GRAM = 36

STRETCH_SCHEMA = (
    "bucket long, kind long, hashes binary, bodies binary, sizes binary, ids binary, rows binary, "
    "starts binary"
)
REPEAT_SCHEMA = "bucket long, ids binary, rows binary, starts binary, sizes binary"


class Rolling:
    """Hashes of all `gram`-byte strings of a text, from running sums of byte values."""

    def __init__(self, gram: int) -> None:
        self.gram = gram
        self.values = mix64(np.arange(1, 257, dtype=np.uint64))
        self._powers(1 << 14)

    def _powers(self, n: int) -> None:
        base = 0x9E3779B97F4A7C15
        inverse = pow(base, -1, 1 << 64)
        # Products wrap, which is arithmetic modulo 2**64.
        self.up = np.multiply.accumulate(np.full(n, base, np.uint64))
        self.down = np.multiply.accumulate(np.full(n, inverse, np.uint64))

    def __call__(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if n < self.gram:
            return np.zeros(0, np.uint64)
        if n > len(self.up):
            self._powers(2 * n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[:n], out=sums[1:])
        places = n - self.gram + 1
        return mix64((sums[self.gram :] - sums[:places]) * self.down[:places])


def _find_anchors(length: int, gram: int):
    def find(texts: pa.Array):
        rolling = Rolling(gram)
        data, offsets = joined_utf8(texts)
        hashes, rows, places = [], [], []
        for i in range(len(texts)):
            own = rolling(data[offsets[i] : offsets[i + 1]])
            at, _, _ = winnow(own, length - gram + 1)
            hashes.append(own[at])
            rows.append(np.full(len(at), i))
            places.append(at)
        return np.concatenate(hashes), np.concatenate(rows), np.concatenate(places)

    return find


def _columns(out: list[tuple], schema: str) -> pa.Table:
    names = [part.split() for part in schema.split(",")]
    columns = list(zip(*out)) if out else [[] for _ in names]
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    return pa.table({n: pa.array(c, kinds[k]) for (n, k), c in zip(names, columns)})


def _repeat_rows(buckets: int, ids, rows, starts, sizes) -> list[tuple]:
    return [
        (b, i.tobytes(), r.tobytes(), s.tobytes(), z.tobytes())
        for b, (i, r, s, z) in split_rows(bucket_of(ids, buckets), ids, rows, starts, sizes)
    ]


def _stretch_cutter(length: int, gram: int, buckets: int):
    """cogroup of documents and wanted anchors of one bucket: stretches for the shards."""

    def run(docs: pa.Table, requests: pa.Table) -> pa.Table:
        wanted = wanted_places(requests)
        rolling = Rolling(gram)
        ids, rows = docs.column("doc_id").to_numpy(), docs.column("row_hash").to_numpy()
        texts = docs.column("text").combine_chunks()
        data, offsets = joined_utf8(texts)
        order = np.lexsort((rows, ids))
        entries: dict[bytes, list] = {}
        known: list[tuple[int, int, int, int]] = []
        before = None
        for k in order.tolist():
            key = (int(ids[k]), int(rows[k]))
            if key == before or key[0] not in wanted:
                continue
            before = key
            text = data[offsets[k] : offsets[k + 1]]
            own = rolling(text)
            at, first, count = winnow(own, length - gram + 1)
            use = np.isin(at, wanted[key[0]])
            raw = text.tobytes()
            for p, f, c in zip(own[at[use]].tolist(), first[use].tolist(), count[use].tolist()):
                body = raw[f : f + c + length - 1]
                digest = xxhash.xxh3_128_digest(body)
                if digest in entries:
                    known.append((*key, f, c))
                else:
                    entries[digest] = [p, body, *key, f]
        out: list[tuple] = []
        if entries:
            found = list(entries.values())
            hashes = np.array([e[0] for e in found], np.uint64)
            index = np.arange(len(found))
            for bucket, (h, pick) in split_rows((hashes % np.uint64(buckets)).astype(np.int64), hashes, index):
                chosen = [found[i] for i in pick.tolist()]
                out.append(
                    (
                        bucket,
                        OPEN,
                        h.tobytes(),
                        b"".join([e[1] for e in chosen]),
                        np.array([len(e[1]) for e in chosen], np.int64).tobytes(),
                        np.array([e[2] for e in chosen], np.int64).tobytes(),
                        np.array([e[3] for e in chosen], np.int64).tobytes(),
                        np.array([e[4] for e in chosen], np.int64).tobytes(),
                    )
                )
        if known:
            table = np.array(known, np.int64)
            for b, i, r, s, z in _repeat_rows(buckets, *np.ascontiguousarray(table.T)):
                out.append((b, KNOWN, b"", b"", z, i, r, s))
        return _columns(out, STRETCH_SCHEMA)

    return run


def window_repeats(
    bodies: list[bytes], ids: np.ndarray, rows: np.ndarray, starts: np.ndarray, length: int, memory: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, first window, number of windows) that have an earlier equal window."""
    which, offset, shared = sorted_suffixes(bodies, length, memory)
    sizes = np.array([len(b) for b in bodies], np.int64)
    group = np.cumsum(shared < length)
    window = offset + length <= sizes[which]
    which, offset, group = which[window], offset[window], group[window]
    several = np.bincount(group)[group] > 1
    which, offset, group = which[several], offset[several], group[several]
    order = np.lexsort((starts[which] + offset, rows[which], ids[which], group))
    later = np.ones(len(order), bool)
    later[run_starts(group[order])] = False
    hit = order[later]
    code = np.sort(which[hit] * (int(sizes.max(initial=0)) + 1) + offset[hit])
    new = np.r_[True, np.diff(code) != 1] if len(code) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    width = int(sizes.max(initial=0)) + 1
    return code[first] // width, code[first] % width, np.diff(np.r_[first, len(code)])


def _shard_sorter(length: int, buckets: int, memory: int):
    """applyInArrow over a shard: repeats by bucket of their document."""

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        blobs = {c: table.column(c).to_pylist() for c in table.column_names if c not in ("bucket", "kind")}
        rows_of = lambda what, c, dtype: unpack([blobs[c][i] for i in np.flatnonzero(kind == what)], dtype)
        hashes = rows_of(OPEN, "hashes", np.uint64)
        sizes, ids, rows, starts = (rows_of(OPEN, c, np.int64) for c in ("sizes", "ids", "rows", "starts"))
        text = b"".join([blobs["bodies"][i] for i in np.flatnonzero(kind == OPEN)])
        ends = np.cumsum(sizes)
        bodies = [text[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist())]
        # Equal stretches: the earliest stands for all.
        first: dict[bytes, int] = {}
        stands, again = [], []
        for i in np.lexsort((starts, rows, ids)).tolist():
            (again if bodies[i] in first else stands).append(i)
            first.setdefault(bodies[i], i)
        again = np.array(again, np.int64)
        out_ids = [rows_of(KNOWN, "ids", np.int64), ids[again]]
        out_rows = [rows_of(KNOWN, "rows", np.int64), rows[again]]
        out_starts = [rows_of(KNOWN, "starts", np.int64), starts[again]]
        out_sizes = [rows_of(KNOWN, "sizes", np.int64), sizes[again] - length + 1]
        # An anchor with one stretch only has nothing to be sorted against.
        stands = np.array(stands, np.int64)
        order = stands[np.argsort(hashes[stands], kind="stable")]
        begin = run_starts(hashes[order])
        count = np.diff(np.r_[begin, len(order)])
        use = order[np.repeat(count > 1, count)]
        if len(use):
            k, offset, windows = window_repeats(
                [bodies[i] for i in use.tolist()], ids[use], rows[use], starts[use], length, memory
            )
            out_ids.append(ids[use][k])
            out_rows.append(rows[use][k])
            out_starts.append(starts[use][k] + offset)
            out_sizes.append(windows)
        packed = [np.concatenate(x).astype(np.int64) for x in (out_ids, out_rows, out_starts, out_sizes)]
        return _columns(_repeat_rows(buckets, *packed), REPEAT_SCHEMA)

    return run


def cover(starts: np.ndarray, stops: np.ndarray, size: int) -> np.ndarray:
    """Which of `size` places some [start, stop) covers."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, stops, -1)
    return np.cumsum(edge[:-1]) > 0


def repeats_by_row(table: pa.Table) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    ids, rows, starts, sizes = (unpack(table.column(c).to_pylist(), np.int64) for c in ("ids", "rows", "starts", "sizes"))
    order = np.lexsort((rows, ids))
    ids, rows, starts, sizes = ids[order], rows[order], starts[order], sizes[order]
    if not len(ids):
        return {}
    begin = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1])])
    return {
        (int(ids[a]), int(rows[a])): (starts[a:b], sizes[a:b])
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(ids)])
    }


def _remover(length: int):
    def run(docs: pa.Table, repeats: pa.Table) -> pa.Table:
        cut = repeats_by_row(repeats)
        out: list[list] = [[], [], [], [], [], []]
        for doc_id, row_hash, text in zip(*(docs.column(c).to_pylist() for c in ("doc_id", "row_hash", "text"))):
            data = text.encode()
            spans = []
            if (doc_id, row_hash) in cut:
                starts, windows = cut[doc_id, row_hash]
                gone = cover(starts, starts + windows + length - 1, len(data))
                edges = np.flatnonzero(np.diff(np.r_[0, gone.view(np.int8), 0]))
                spans = [{"start": a, "stop": b} for a, b in edges.reshape(-1, 2).tolist()]
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            else:
                kept = data
            found = (doc_id, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans)
            for column, value in zip(out, found):
                column.append(value)
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        kinds = [pa.int64()] * 4 + [pa.string(), span]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, out, kinds)})

    return run


def suffix_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    memory: int = QUEUE_MEMORY,
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans.

    A byte goes if a string of `length` bytes over it starts earlier as well, in
    a smaller id or before in its document; strings do not cross documents and
    are judged on the input. spans are the maximal runs removed. NULL texts are
    empty; texts shorter than `length` stay. A NULL id is below all others. Rows
    that share an id but not a text are ordered by a hash of the text; a row
    repeated whole is one document, and each repetition gets its result.
    """
    spark = docs.sparkSession
    buckets = bucket_count(spark)
    rows = spread_nulls(keyed(docs, id_col, text_col))
    texts = by_bucket(rows, buckets)
    requests = repeated_places(rows, _find_anchors(length, gram), buckets)
    stretches = (
        texts.groupBy("bucket")
        .cogroup(requests.groupBy("bucket"))
        .applyInArrow(_stretch_cutter(length, gram, buckets), STRETCH_SCHEMA)
    )
    repeats = stretches.groupBy("bucket").applyInArrow(_shard_sorter(length, buckets, memory), REPEAT_SCHEMA)
    done = (
        texts.groupBy("bucket")
        .cogroup(repeats.groupBy("bucket"))
        .applyInArrow(
            _remover(length),
            "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
            "spans array<struct<start: long, stop: long>>",
        )
    )
    return done.withColumn("doc_id", public_spread_id())
