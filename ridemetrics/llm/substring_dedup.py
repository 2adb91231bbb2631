"""Removal of repeated passages of words: seed and extend.

Seeds are winnowed hashes of `seed_words` words. Documents meet on seeds that
occur more than once. At each, the match is extended both ways: to the left by
every number of words up to the window's length less the seed's, to the right by
the rest. Two pairs of hashes of the extensions, 128 bits, name the window, and
occurrences with the same name match. Windows meet by name, so a seed in many
documents is spread over as many tasks as it has surroundings, and equal windows
of a task are one entry. Windows that match run together into maximal repeats,
and words under them go, in every document that has them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
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
from ridemetrics.llm.common import joined_utf8, keyed, mix64, public_spread_id, spread_nulls, unpack
from ridemetrics.llm.suffix_dedup import REPEAT_SCHEMA, _columns, _repeat_rows, cover, repeats_by_row

WINDOW_WORDS = 35
SEED_WORDS = 8

MATCH_SCHEMA = "bucket long, kind long, names binary, checks binary, ids binary, rows binary, starts binary"

_BASE = 0x9E3779B97F4A7C15
#: Turns a word's hash into another one, for the second half of names.
_OTHER = 0xC2B2AE3D27D4EB4F


def _is_space() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


class WordHashes:
    """Hashes of the words of a text and of runs of words."""

    def __init__(self) -> None:
        self.space = _is_space()
        self.values = mix64(np.arange(1, 257, dtype=np.uint64))
        self._powers(1 << 14)

    def _powers(self, n: int) -> None:
        self.up = np.multiply.accumulate(np.full(n, _BASE, np.uint64))
        self.down = np.multiply.accumulate(np.full(n, pow(_BASE, -1, 1 << 64), np.uint64))

    def words(self, data: np.ndarray) -> np.ndarray:
        if len(data) >= len(self.up):
            self._powers(2 * len(data))
        inside = ~self.space[data]
        edges = np.flatnonzero(np.diff(np.r_[False, inside, False].view(np.int8)))
        starts, stops = edges[::2], edges[1::2]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[: len(data)], out=sums[1:])
        length = (stops - starts).astype(np.uint64)
        return mix64(mix64((sums[stops] - sums[starts]) * self.down[starts]) + length)

    def runs(self, words: np.ndarray, count: int) -> np.ndarray:
        """Hash of each `count` words in a row."""
        n = len(words)
        if n < count:
            return np.zeros(0, np.uint64)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * self.up[:n], out=sums[1:])
        return mix64((sums[count:] - sums[: n - count + 1]) * self.down[: n - count + 1])


def _find_seeds(window: int, seed: int):
    def find(texts: pa.Array):
        hasher = WordHashes()
        data, offsets = joined_utf8(texts)
        hashes, rows, places = [], [], []
        for i in range(len(texts)):
            own = hasher.runs(hasher.words(data[offsets[i] : offsets[i + 1]]), seed)
            at, _, _ = winnow(own, window - seed + 1)
            hashes.append(own[at])
            rows.append(np.full(len(at), i))
            places.append(at)
        return np.concatenate(hashes), np.concatenate(rows), np.concatenate(places)

    return find


def extensions(hasher: WordHashes, words: np.ndarray, at: np.ndarray, first: np.ndarray, count: np.ndarray, window: int):
    """Start and both halves of the name of every window of each seed occurrence.

    The seed at `at` is extended by at - start words to the left and by the rest of
    the window to the right; the name holds both extensions and where they meet.
    """
    starts = np.repeat(first, count) + (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count))
    seeds = np.repeat(at, count)

    def names(words: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * hasher.up[: len(words)], out=sums[1:])
        left = mix64((sums[seeds] - sums[starts]) * hasher.down[starts])
        right = mix64((sums[starts + window] - sums[seeds]) * hasher.down[seeds])
        return mix64(left + mix64(right + (seeds - starts).astype(np.uint64)))

    return starts, names(words), names(mix64(words ^ np.uint64(_OTHER)))


def by_name(names: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal names together, and where each begins in it."""
    order = np.argsort(names, kind="stable")

    def begins() -> np.ndarray:
        a, b = names[order], checks[order]
        return np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(order) else np.zeros(0, bool)

    new = begins()
    if new.sum() != len(np.unique(names)):
        # Halves alike and wholes not: a matter of one in 2**64.
        order = np.lexsort((checks, names))
        new = begins()
    return order, np.flatnonzero(new)


def _extender(window: int, seed: int, buckets: int):
    """cogroup of documents and repeated seeds of one bucket: named windows."""

    def run(docs: pa.Table, requests: pa.Table) -> pa.Table:
        wanted = wanted_places(requests)
        hasher = WordHashes()
        ids, rows = docs.column("doc_id").to_numpy(), docs.column("row_hash").to_numpy()
        data, offsets = joined_utf8(docs.column("text").combine_chunks())
        parts: list[tuple] = []
        before = None
        for k in np.lexsort((rows, ids)).tolist():
            key = (int(ids[k]), int(rows[k]))
            if key == before or key[0] not in wanted:
                continue
            before = key
            words = hasher.words(data[offsets[k] : offsets[k + 1]])
            own = hasher.runs(words, seed)
            at, first, count = winnow(own, window - seed + 1)
            use = np.isin(at, wanted[key[0]])
            starts, names, checks = extensions(hasher, words, at[use], first[use], count[use], window)
            parts.append((names, checks, np.full(len(names), key[0]), np.full(len(names), key[1]), starts))
        if not parts:
            return _columns([], MATCH_SCHEMA)
        names, checks, ids, rows, starts = (np.concatenate(x) for x in zip(*parts))
        order, begin = by_name(names, checks)
        names, checks, ids, rows, starts = (x[order] for x in (names, checks, ids, rows, starts))
        count = np.diff(np.r_[begin, len(names)])
        several = np.repeat(count > 1, count)
        # One entry per name; without a place where this bucket already has the match.
        entry_start = np.where(count > 1, -1, starts[begin])
        goes = (names[begin] % np.uint64(buckets)).astype(np.int64)
        out = [
            (b, OPEN, n.tobytes(), c.tobytes(), i.tobytes(), r.tobytes(), s.tobytes())
            for b, (n, c, i, r, s) in split_rows(goes, names[begin], checks[begin], ids[begin], rows[begin], entry_start)
        ]
        known = (ids[several], rows[several], starts[several])
        for b, (i, r, s) in split_rows(bucket_of(known[0], buckets), *known):
            out.append((b, KNOWN, b"", b"", i.tobytes(), r.tobytes(), s.tobytes()))
        return _columns(out, MATCH_SCHEMA)

    return run


def _matcher(buckets: int):
    """applyInArrow over the windows of one bucket: maximal runs of matching ones."""

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        blobs = {c: table.column(c).to_pylist() for c in ("names", "checks", "ids", "rows", "starts")}
        of = lambda what, c, dtype: unpack([blobs[c][i] for i in np.flatnonzero(kind == what)], dtype)
        names, checks = (of(OPEN, c, np.uint64) for c in ("names", "checks"))
        ids, rows, starts = (of(OPEN, c, np.int64) for c in ("ids", "rows", "starts"))
        order, begin = by_name(names, checks)
        count = np.diff(np.r_[begin, len(names)])
        match = np.zeros(len(names), bool)
        match[order] = np.repeat(count > 1, count)
        match &= starts >= 0
        ids, rows, starts = (
            np.r_[x[match], of(KNOWN, c, np.int64)] for x, c in ((ids, "ids"), (rows, "rows"), (starts, "starts"))
        )
        order = np.lexsort((starts, rows, ids))
        ids, rows, starts = ids[order], rows[order], starts[order]
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1]) | (starts[1:] - starts[:-1] > 1)
        begin = np.flatnonzero(new)
        last = np.r_[begin[1:], len(ids)] - 1
        if not len(ids):
            return _columns([], REPEAT_SCHEMA)
        return _columns(
            _repeat_rows(buckets, ids[begin], rows[begin], starts[begin], starts[last] - starts[begin] + 1), REPEAT_SCHEMA
        )

    return run


def _word_remover(window: int):
    def run(docs: pa.Table, repeats: pa.Table) -> pa.Table:
        cut = repeats_by_row(repeats)
        out: list[list] = [[], [], [], [], []]
        for doc_id, row_hash, text in zip(*(docs.column(c).to_pylist() for c in ("doc_id", "row_hash", "text"))):
            # bytes.split cuts at exactly the six white space bytes.
            words = text.encode().split()
            kept, spans = words, []
            if (doc_id, row_hash) in cut:
                starts, windows = cut[doc_id, row_hash]
                gone = cover(starts, starts + windows + window - 1, len(words))
                kept = [words[i] for i in np.flatnonzero(~gone).tolist()]
                edges = np.flatnonzero(np.diff(np.r_[0, gone.view(np.int8), 0]))
                spans = [{"start": a, "stop": b} for a, b in edges.reshape(-1, 2).tolist()]
            digest = hashlib.sha256(b" ".join(kept)).hexdigest()
            for column, value in zip(out, (doc_id, len(words), len(words) - len(kept), digest, spans)):
                column.append(value)
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        kinds = [pa.int64()] * 3 + [pa.string(), span]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "spans"]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, out, kinds)})

    return run


def substring_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW_WORDS,
    seed: int = SEED_WORDS,
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_removed, kept_sha256, spans.

    A word goes if `window` words in a row over it also start elsewhere, in the
    same document too; windows are judged on the input. spans are the maximal
    runs of words removed. NULL and blank texts have no words, and texts shorter
    than a window stay. A row repeated whole is one document, not a repeat of
    itself, and each repetition gets its result; rows that share an id but not a
    text are two documents. A NULL id is an id like another.
    """
    buckets = bucket_count(docs.sparkSession)
    rows = spread_nulls(keyed(docs, id_col, text_col))
    texts = by_bucket(rows, buckets)
    requests = repeated_places(rows, _find_seeds(window, seed), buckets)
    windows = (
        texts.groupBy("bucket")
        .cogroup(requests.groupBy("bucket"))
        .applyInArrow(_extender(window, seed, buckets), MATCH_SCHEMA)
    )
    repeats = windows.groupBy("bucket").applyInArrow(_matcher(buckets), REPEAT_SCHEMA)
    done = (
        texts.groupBy("bucket")
        .cogroup(repeats.groupBy("bucket"))
        .applyInArrow(
            _word_remover(window),
            "doc_id long, n_words long, n_removed long, kept_sha256 string, "
            "spans array<struct<start: long, stop: long>>",
        )
    )
    return done.withColumn("doc_id", public_spread_id())
