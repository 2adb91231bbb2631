"""Language-model scores by logistic context mixing over bits.

A text is its lower-cased words joined by single spaces, and an end mark. Each
byte is a path of yes-or-no steps through the code tree of the byte before it,
made from counts of byte pairs over all training documents. For every step,
several contexts (the last three and five bytes, and the word so far) are
hashed with the step to a slot of their table, whose counts over all training
documents give a probability and how sure it is. The predictions are added in the
logistic domain under weights that a gate picks by how sure the longest contexts
are, and a last stage corrects the mix by its own size. Weights and corrections
start the same for every document and are refined within it, after stretches that
double in length, so a score depends on its document and the training counts only.

What the bits give for a word is mixed with the word's count, under a weight that
goes by the size of the count and shifts with what either predicted better in the
document so far. Word counts grow with the corpus without a bound: documents ask
for the counts of their words by a shuffle. Tables of bits have a fixed size; they
and the pair counts are all that is sent to every task.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridemetrics.llm.anchors import bucket_count, by_bucket, split_rows
from ridemetrics.llm.common import (
    NULL_ID,
    NULL_SPREAD,
    keyed,
    materialise,
    mix64,
    public_spread_id,
    run_starts,
    shuffle_width,
    spread_nulls,
    unpack,
    utf8_slices,
)
from ridemetrics.llm.substring_dedup import WordHashes

FOLDS = 10
END = 10  # a line feed is in no word
PAD = 5
#: log2 of the slots of each context's table: three bytes, five bytes, the word so far.
TABLE_BITS = (20, 22, 22)
TABLE_SLICE = 1 << 18
COUNTS, WORDS = 0, 1
SMOOTH = 0.1

#: Slots that the steps under one context share: a line of memory, so a byte's steps are near each other.
BLOCK = 64
#: Weight of a byte that training never showed after another.
UNSEEN = 0.02


def code_trees(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A Huffman tree over bytes for each byte before: start and length of each pair's path, nodes and bits of all paths.

    `pairs` counts (byte before, byte). Frequent pairs take few steps, and every
    byte can be told after every other. Nodes are numbered modulo BLOCK: the BLOCK
    nodes next to a root, where nearly all steps are, have numbers of their own.
    """
    starts, lengths, nodes, bits = [], [], [], []
    for before, weight in enumerate(pairs.astype(np.float64) + UNSEEN):
        heap = [(float(w), b, b) for b, w in enumerate(weight)]
        heapq.heapify(heap)
        parent: dict[int, tuple[int, int]] = {}
        for following in range(256, 511):
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            parent[a[2]], parent[b[2]] = (following, 0), (following, 1)
            heapq.heappush(heap, (a[0] + b[0], following, following))
        for byte in range(256):
            path = []
            at = byte
            while at in parent:
                path.append(parent[at])
                at = parent[at][0]
            starts.append(len(nodes))
            lengths.append(len(path))
            for node, bit in reversed(path):
                nodes.append(node % BLOCK)
                bits.append(bit)
    kinds = (np.int32, np.int32, np.uint32, np.uint8)
    return tuple(np.array(column, kind) for column, kind in zip((starts, lengths, nodes, bits), kinds))


def coded_text(text: bytes) -> bytes:
    """What the model spells: lower-cased words joined by single spaces, and an end."""
    return b" ".join(text.lower().split()) + bytes([END])


def picked(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """values[at], for places known to be inside: not checking them is up to twice as fast."""
    return values.take(at, mode="clip")


class Coder:
    """Code trees, and the powers that word hashes need, for the texts of a task."""

    def __init__(self, trees: tuple) -> None:
        self.starts, self.lengths, self.nodes, self.bits = trees
        self.known = (np.zeros(0, np.uint64),) * 2

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """At least `n` powers of an odd number and of its inverse, modulo 2**64."""
        if len(self.known[0]) < n:
            size, base = 1 << n.bit_length(), 0x9E3779B97F4A7C15
            self.known = tuple(
                np.multiply.accumulate(np.full(size, b, np.uint64)) for b in (base, pow(base, -1, 1 << 64))
            )
        return self.known


class Steps:
    """The code steps of some texts: slots of each context, and bit.

    To score, they are ordered by stretch, and it is told which document and word
    each is of; counting needs neither.
    """

    def __init__(self, texts: list[bytes], coder: Coder, scored: bool = True) -> None:
        pad = bytes([END]) * PAD
        bodies = [pad + coded_text(t) for t in texts]
        sizes = np.array([len(b) for b in bodies])
        data = np.frombuffer(b"".join(bodies), np.uint8)
        begin = np.cumsum(sizes) - sizes
        coded = np.ones(len(data), bool)
        coded[(begin[:, None] + np.arange(PAD)).reshape(-1)] = False
        at = np.flatnonzero(coded)
        if scored:
            at = self._by_stretch(at, begin, sizes)
        wide = data.astype(np.uint32)
        three = wide[at - 1] | wide[at - 2] << np.uint32(8) | wide[at - 3] << np.uint32(16)
        five = (three | wide[at - 4] << np.uint32(24)) * np.uint32(0x01000193) + wide[at - 5] * np.uint32(0x27D4EB2F)
        contexts = [three, five, self._word_so_far(data, at, coder)]
        pair = (three & np.uint32(255)) << np.uint32(8) | wide[at]
        n = coder.lengths[pair]
        ends = np.cumsum(n)
        # Picking by place is several times faster than repeating each array.
        of_byte = np.repeat(np.arange(len(n)), n)
        path = picked(coder.starts[pair] - ends + n, of_byte)
        path += np.arange(len(path))
        step = picked(coder.nodes, path)
        self.bit = picked(coder.bits, path)
        if scored:
            self._tell(data, coded, at, begin, sizes, of_byte, ends - n)
        self.slots = []
        for k, (context, width) in enumerate(zip(contexts, TABLE_BITS)):
            mixed = (context + np.uint32(k + 1)) * np.uint32(0x85EBCA6B)
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(13)
            mixed *= np.uint32(0xC2B2AE35)
            mixed >>= np.uint32(32 - width)
            # The upper bits choose a block, the lower ones where its nodes begin.
            slot = picked(mixed, of_byte)
            slot ^= step
            self.slots.append(slot)

    def _by_stretch(self, at: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Places of bytes in order of their stretch, which end at 64, 192, 448 ... bytes of a document."""
        doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes - PAD)
        unit = (at - begin[doc] - PAD) >> 6
        stretch = (np.frexp(np.arange(1, int(unit.max()) + 2))[1] - 1).astype(np.uint8)[unit]
        # What is learnt in a document's last stretch has no use: those come after the others.
        last = np.zeros(len(sizes), np.uint8)
        last[doc] = stretch
        turn = 2 * stretch + (stretch == last[doc])
        order = np.argsort(turn, kind="stable")
        self.of_doc, self.turn = doc[order], turn[order]
        return at[order]

    def _tell(self, data, coded, at, begin, sizes, of_byte, first) -> None:
        """Document and byte of each step, word of each byte, and where stretches are."""
        self.of_byte = of_byte
        self.doc = picked(self.of_doc, of_byte)
        # Words with the space or end behind them, numbered over all texts.
        cut = coded & ((data == 32) | (data == END))
        words = np.cumsum(cut, dtype=np.int32)
        self.words = int(words[-1])
        self.word = (words - cut)[at]
        self.word_doc = np.repeat(np.arange(len(sizes)), np.diff(np.r_[0, words[begin + sizes - 1]]))
        # Of each stretch: begin, begin of what is last, end; in bytes and in steps.
        bounds = np.searchsorted(self.turn, np.arange(int(self.turn[-1]) // 2 * 2 + 3))
        self.bytes = bounds.tolist()
        self.edges = np.r_[first, len(of_byte)][bounds].tolist()

    @staticmethod
    def _word_so_far(data: np.ndarray, at: np.ndarray, coder: Coder) -> np.ndarray:
        """Hash of the bytes since the last space or end."""
        cut = (data == 32) | (data == END)
        values = mix64(np.arange(1, 257, dtype=np.uint64))[data]
        powers, inverse = coder.powers(len(data) + 1)
        values *= powers[: len(data)]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values, out=sums[1:])
        first = np.maximum.accumulate(np.where(cut, np.arange(1, len(data) + 1), 0))
        since = first[at - 1]
        return (mix64((sums[at] - sums[since]) * inverse[since]) >> np.uint64(32)).astype(np.uint32)


def in_training(doc_id: int, folds: int) -> bool:
    return doc_id >= NULL_ID + NULL_SPREAD and zlib.crc32(str(doc_id).encode()) % folds != 0


def _learnt(folds: int) -> Column:
    return (F.col("doc_id") >= NULL_ID + NULL_SPREAD) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != 0)


def _words_of(hasher: WordHashes, texts: list[bytes]) -> list[np.ndarray]:
    """Word hashes of runs of texts; each text's words are followed by its end."""
    return [hasher.words(np.frombuffer(b"".join([t.lower() + END_MARK for t in g]), np.uint8)) for g in grouped(texts, 1 << 16)]


def _words_by_text(hasher: WordHashes, texts: list[bytes]) -> list[np.ndarray]:
    words = np.concatenate([np.zeros(0, np.uint64), *_words_of(hasher, texts)])
    stops = np.flatnonzero(words == hasher.words(np.frombuffer(END_MARK, np.uint8))[0]) + 1
    return np.split(words, stops)[: len(texts)]


#: Stands for the end of a text among its words: upper-case, so no lower-cased word is like it.
END_MARK = b"\nEND\n"


def _pair_counter(folds: int):
    """pair, n: how often a byte follows another in the training documents of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(1 << 16, np.int64)
        for batch in utf8_slices(batches):
            learnt = [in_training(i, folds) for i in batch.column("doc_id").to_pylist()]
            texts = [bytes([END]) + coded_text(t.as_py().encode()) for t, use in zip(batch.column("text"), learnt) if use]
            if not texts:
                continue
            data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint16)
            both = data[:-1] << np.uint16(8) | data[1:]
            # The end of a text and what stands before the next are no pair.
            both = np.delete(both, np.cumsum([len(t) for t in texts[:-1]], dtype=np.int64) - 1)
            pairs += np.bincount(both, minlength=1 << 16)
        some = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(pairs[some])], ["pair", "n"])

    return run


def _counter(folds: int, buckets: int, trees):
    """Counts of word hashes and of table slots over the training documents of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(trees.value)
        hasher = WordHashes()
        tables = [np.zeros(2 << width, np.uint32) for width in TABLE_BITS]
        names = ["key", "kind", "first", "second"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]

        def rows(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

        for batch in utf8_slices(batches):
            learnt = [in_training(i, folds) for i in batch.column("doc_id").to_pylist()]
            texts = [t.as_py().encode() for t, use in zip(batch.column("text"), learnt) if use]
            if not texts:
                continue
            for group in grouped(texts, 1 << 16):
                steps = Steps(group, coder, scored=False)
                for slot, table in zip(steps.slots, tables):
                    np.add.at(table, (slot << np.uint32(1)) | steps.bit, np.uint32(1))
            words, counts = np.unique(np.concatenate(_words_of(hasher, texts)), return_counts=True)
            goes = (words % np.uint64(buckets)).astype(np.int64)
            yield rows(
                [(b, WORDS, w.tobytes(), c.astype(np.int64).tobytes()) for b, (w, c) in split_rows(goes, words, counts)]
            )
        out = []
        for k, table in enumerate(tables):
            for s in range(0, len(table), 2 * TABLE_SLICE):
                part = table[s : s + 2 * TABLE_SLICE]
                if part.any():
                    out.append(((k << 20) + s // (2 * TABLE_SLICE), COUNTS, zlib.compress(part.tobytes(), 1), b""))
        if out:
            yield rows(out)

    return run


def grouped(texts: list[bytes], limit: int) -> Iterator[list[bytes]]:
    """Texts in runs of about `limit` bytes."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def quantise(counts: np.ndarray) -> np.ndarray:
    """A slot in one byte: its logit in quarters (upper six bits, signed) and sureness 0 to 3."""
    zero, one = counts[::2].astype(np.float64), counts[1::2].astype(np.float64)
    logit = np.log((one + 0.4) / (zero + 0.4))
    level = np.searchsorted([0.5, 3.5, 30.5], zero + one).astype(np.uint8)
    return np.clip(np.rint(logit * 4), -32, 31).astype(np.int8).view(np.uint8) << np.uint8(2) | level


def _summer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums per key: word counts, and quantised slices of tables."""
    tables: dict[int, np.ndarray] = {}
    words: dict[int, list] = {}

    def combined(parts: list) -> tuple[np.ndarray, np.ndarray]:
        names = np.concatenate([p[0] for p in parts])
        counts = np.concatenate([p[1] for p in parts])
        order = np.argsort(names, kind="stable")
        begin = run_starts(names[order])
        return names[order][begin], np.add.reduceat(counts[order], begin)

    for batch in batches:
        for key, kind, first, second in zip(*(batch.column(c).to_pylist() for c in ("key", "kind", "first", "second"))):
            if kind == COUNTS:
                part = np.frombuffer(zlib.decompress(first), np.uint32)
                tables.setdefault(key, np.zeros(len(part), np.uint64))
                tables[key] += part
            else:
                held = words.setdefault(key, [])
                held.append((np.frombuffer(first, np.uint64), np.frombuffer(second, np.int64)))
                if len(held) >= 16:
                    words[key] = [combined(held)]
    for key, table in tables.items():
        yield _sum_row(key, COUNTS, quantise(table).tobytes(), b"", 0, 0)
    for key, held in words.items():
        names, counts = combined(held)
        yield _sum_row(key, WORDS, names.tobytes(), counts.tobytes(), int(counts.sum()), len(names))


def _sum_row(key: int, kind: int, first: bytes, second: bytes, total: int, distinct: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(
        [{"key": key, "kind": kind, "first": first, "second": second, "total": total, "distinct": distinct}]
    )


#: Weights at the start, by how sure the context is (rows) and which it is (columns).
START = np.array(
    [
        [0.0, 0.0, 0.0],
        [0.15, 0.3, 0.0],
        [0.15, 0.5, 0.25],
        [0.3, 0.65, 0.35],
    ],
    np.float32,
)
GATES = 16
RATE = 0.03
RATE_LAST = 0.3


def start_weights() -> np.ndarray:
    """(gate, context); a gate is the sureness of the two longer contexts."""
    longer = np.stack(np.meshgrid(range(4), range(4), indexing="ij"), axis=-1).reshape(-1, 2)
    sure = np.concatenate([np.full((GATES, 1), 3), longer], axis=1)
    weights = START[sure, np.arange(3)]
    # What the longer contexts do not claim goes to the shorter ones.
    claimed = weights.sum(axis=1, keepdims=True)
    weights[:, :1] += np.maximum(0, 1.0 - claimed)
    return weights


def bits_of(texts: list[bytes], tables: list[np.ndarray], coder: Coder) -> tuple[np.ndarray, np.ndarray]:
    """Bits that the model takes for each word, with the space or end behind it, and the text each is of."""
    steps = Steps(texts, coder)
    n = len(texts)
    start = start_weights()
    weights = [np.tile(start[:, k], n) for k in range(len(TABLE_BITS))]
    last = np.zeros(n * 16, np.float32)
    out = np.zeros(steps.words)
    stretches = zip(steps.edges[::2], steps.edges[1::2], steps.edges[2::2], steps.bytes[::2], steps.bytes[2::2])
    for a, end, b, first_byte, last_byte in stretches:
        doc = steps.doc[a:b]
        packed = [picked(table, slots[a:b]) for table, slots in zip(tables, steps.slots)]
        gate = (packed[1] & np.uint8(3)) << np.uint8(2) | (packed[2] & np.uint8(3))
        # Index arrays of the machine's own width are not copied at each use.
        row = doc * np.intp(GATES)
        row += gate
        # Logits times 4.
        inputs = [(p.view(np.int8) >> np.int8(2)).astype(np.float32) for p in packed]
        mixed = picked(weights[0], row)
        mixed *= inputs[0]
        for w, x in zip(weights[1:], inputs[1:]):
            part = picked(w, row)
            part *= x
            mixed += part
        mixed *= np.float32(1 / 4)
        own = doc * np.intp(16)
        place = mixed + np.float32(8.5)
        np.maximum(place, 0, out=place)
        np.minimum(place, 15, out=place)
        own += place.astype(np.int32)
        mixed += picked(last, own)
        sign = steps.bit[a:b].astype(np.float32)
        sign *= 2
        sign -= 1
        np.maximum(mixed, -11, out=mixed)
        np.minimum(mixed, 11, out=mixed)
        mixed *= sign
        odds = np.exp(np.negative(mixed, out=mixed))
        if a < b:
            cost = np.bincount(steps.of_byte[a:b] - first_byte, np.log(1 + odds), last_byte - first_byte)
            out += np.bincount(steps.word[first_byte:last_byte], cost, steps.words)
        learn = end - a
        if not learn:
            continue
        row, own, odds = row[:learn], own[:learn], odds[:learn]
        error = odds / (1 + odds)
        change = np.bincount(own, error * (1 - error), n * 16) + 4.0
        error *= sign[:learn]
        seen = 4 * np.sqrt(np.bincount(row, minlength=n * GATES) + 20.0)
        for w, x in zip(weights, inputs):
            w += (RATE * np.bincount(row, error * x[:learn], n * GATES) / seen).astype(np.float32)
        last += (RATE_LAST * np.bincount(own, error, n * 16) / change).astype(np.float32)
    return out / np.log(2), steps.word_doc


#: Where the weight of a word's count starts, by the count: 0, 1, 2 to 3, 4 to 7, 8 to 15, 16 to 63, more.
WORD_STEPS = np.array([0.5, 1.5, 3.5, 7.5, 15.5, 63.5])
WORD_START = np.array([0.0, 0.8, 0.7, 0.35, 0.18, 0.08, 0.05])
#: How fast the weight shifts within a document, in logits per nat, and how far.
WORD_RATE = 0.01
WORD_SHIFT = 4.0


def mixed_words(bits: np.ndarray, doc: np.ndarray, counts: np.ndarray, last: np.ndarray, total: int, ends: int) -> np.ndarray:
    """log10 of the probability of each word, from its bits and its count.

    A word stands for itself and whether the text ends behind it; a count of -1
    is the end of an empty text.
    """
    spelt = 2.0**-bits
    if not total:
        return np.log10(spelt)
    end = ends / total
    counted = np.where(counts > 0, counts / max(1, total - ends), 0.0) * np.where(last, end, 1 - end)
    counted[counts < 0] = end
    start = WORD_START[np.searchsorted(WORD_STEPS, counts)]
    start[counts < 0] = 0.5
    usable = (counted > 0) & (start > 0)
    gain = np.zeros(len(bits))
    gain[usable] = np.log(counted[usable]) + bits[usable] * np.log(2)
    before = np.r_[0.0, np.cumsum(gain)]
    before = before[:-1] - before[np.searchsorted(doc, doc)]
    weight = np.zeros(len(bits))
    shift = np.clip(WORD_RATE * before[usable], -WORD_SHIFT, WORD_SHIFT)
    weight[usable] = 1 / (1 + (1 / start[usable] - 1) * np.exp(-shift))
    # Very long words have no probability that a double could hold.
    mixed = (1 - weight) * spelt + weight * counted
    return np.where(mixed > 0, np.log10(np.where(mixed > 0, mixed, 1.0)), -bits * np.log10(2))


def _distinct_words(docs: pa.Table, buckets: int):
    """Word hashes of each text with its end, and the distinct ones in order of (bucket, hash)."""
    hasher = WordHashes()
    words = _words_by_text(hasher, [t.as_py().encode() for t in docs.column("text")])
    distinct = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
    goes = (distinct % np.uint64(buckets)).astype(np.int64)
    return words, list(split_rows(goes, distinct))


def _asker(buckets: int):
    def run(key: tuple, docs: pa.Table) -> pa.Table:
        _, asked = _distinct_words(docs, buckets)
        return pa.table(
            {
                "key": pa.array([b for b, _ in asked], pa.int64()),
                "bucket": pa.array([key[0].as_py()] * len(asked), pa.int64()),
                "words": pa.array([w.tobytes() for _, (w,) in asked], pa.binary()),
            }
        )

    return run


def _answerer(asked: pa.Table, known: pa.Table) -> pa.Table:
    names = unpack(known.column("first").to_pylist(), np.uint64)
    counts = unpack(known.column("second").to_pylist(), np.int64)
    replies = []
    for blob in asked.column("words").to_pylist():
        words = np.frombuffer(blob, np.uint64)
        found = np.zeros(len(words), np.int64)
        if len(names):
            at = np.minimum(np.searchsorted(names, words), len(names) - 1)
            found = np.where(names[at] == words, counts[at], 0)
        # Most counts are small.
        narrow = found.astype(np.uint32)
        replies.append(zlib.compress((narrow if (narrow == found).all() else found).tobytes(), 1))
    return pa.table(
        {
            "bucket": asked.column("bucket"),
            "key": asked.column("key"),
            "counts": pa.array(replies, pa.binary()),
        }
    )


def _scorer(buckets: int, folds: int, total: int, distinct: int, ends: int, trees, tables):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        words, asked = _distinct_words(docs, buckets)
        given = dict(zip(replies.column("key").to_pylist(), replies.column("counts").to_pylist()))
        names, counts = [], []
        for bucket, (own,) in asked:
            body = zlib.decompress(given[bucket])
            names.append(own)
            counts.append(np.frombuffer(body, np.uint32 if len(body) == 4 * len(own) else np.int64).astype(np.int64))
        names = np.concatenate(names) if names else np.zeros(0, np.uint64)
        counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        order = np.argsort(names)
        names, counts = names[order], counts[order]
        logs = np.log10((counts + SMOOTH) / (total + SMOOTH * (distinct + 1)))
        places = [np.searchsorted(names, w) for w in words]
        texts = [t.as_py().encode() for t in docs.column("text")]
        coder, scores, done = Coder(trees.value), [], 0
        for group in grouped(texts, 1 << 17):
            bits, doc = bits_of(group, tables.value, coder)
            own = places[done : done + len(group)]
            done += len(group)
            known = np.concatenate([counts[p[:-1]] if len(p) > 1 else np.full(1, -1) for p in own])
            last = np.r_[doc[1:] != doc[:-1], True]
            scores.append(np.bincount(doc, mixed_words(bits, doc, known, last, total, ends)))
        scores = np.concatenate(scores) if scores else np.zeros(0)
        ids = docs.column("doc_id").to_pylist()
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "held_out": pa.array([not in_training(i, folds) for i in ids], pa.bool_()),
                "n_tokens": pa.array([len(w) for w in words], pa.int64()),
                "n_known": pa.array([int((counts[p] > 0).sum()) for p in places], pa.int64()),
                "train_tokens": pa.array([total] * len(ids), pa.int64()),
                "base_score": pa.array([float(logs[p].sum()) for p in places], pa.float64()),
                "score": pa.array(scores, pa.float64()),
                "bits_per_byte": pa.array([float(-s / np.log10(2) / (len(t) + 1)) for s, t in zip(scores, texts)], pa.float64()),
            }
        )

    return run


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Learns from documents whose crc32(id as text) is not divisible by `folds`.
    score is log10 of the probability of the words and the end; base_score that of
    smoothed word counts. NULL and empty texts are the end alone. A NULL id is held
    out and stays NULL. Repeated rows are learnt from and scored once each. Where
    there is nothing to learn from, every step has even odds.
    """
    spark = docs.sparkSession
    buckets = bucket_count(spark)
    rows = spread_nulls(keyed(docs, id_col, text_col)).select("doc_id", "text")
    # One number per pair of bytes.
    pairs = np.zeros((256, 256), np.int64)
    followed = rows.mapInArrow(_pair_counter(folds), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    for pair, n in followed.collect():
        pairs[pair >> 8, pair & 255] = n
    trees = spark.sparkContext.broadcast(code_trees(pairs))
    schema = "key long, kind long, first binary, second binary"
    learnt = materialise(
        rows.mapInArrow(_counter(folds, buckets, trees), schema)
        .repartition(shuffle_width(spark), "kind", "key")
        .mapInArrow(_summer, schema + ", total long, distinct long"),
        "lm-counts",
    )
    sums = learnt.agg(F.sum("total").alias("total"), F.sum("distinct").alias("distinct")).first()
    # Every training text has one end.
    ends = rows.select("doc_id").filter(_learnt(folds)).count()
    tables = [np.zeros(1 << width, np.uint8) for width in TABLE_BITS]
    # A fixed number of slices of fixed size.
    for row in learnt.filter(F.col("kind") == COUNTS).select("key", "first").collect():
        part = np.frombuffer(bytes(row["first"]), np.uint8)
        at = (row["key"] & ((1 << 20) - 1)) * TABLE_SLICE
        tables[row["key"] >> 20][at : at + len(part)] = part
    shared = spark.sparkContext.broadcast(tables)
    texts = by_bucket(rows, buckets)
    asked = texts.groupBy("bucket").applyInArrow(_asker(buckets), "key long, bucket long, words binary")
    known = learnt.filter(F.col("kind") == WORDS).select("key", "first", "second")
    replies = (
        asked.groupBy("key")
        .cogroup(known.groupBy("key"))
        .applyInArrow(_answerer, "bucket long, key long, counts binary")
    )
    done = (
        texts.groupBy("bucket")
        .cogroup(replies.groupBy("bucket"))
        .applyInArrow(
            _scorer(buckets, folds, sums["total"] or 0, sums["distinct"] or 0, ends, trees, shared),
            "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
            "base_score double, score double, bits_per_byte double",
        )
    )
    return done.withColumn("doc_id", public_spread_id())
