"""Packing token sequences by multiway differencing.

Documents are tokenised where they are read; nothing is shuffled. A task takes
documents until they fill `group_windows` windows, cuts what is longer than a
window into full windows, and spreads the pieces left over the windows by
Karmarkar-Karp differencing: partial partitions are merged largest imbalance
first, the full window of one on the empty window of the other, so that all
come out nearly equal. A document may be cut anywhere, so what still stands
over a window's capacity goes on to the next ones; if all are full, the window
count rises. What does not fill a window waits for the next group, and only the
last windows of a task are shorter, of sizes that need no padding.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import types
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ridemetrics.llm.common import keyed, public_id

WINDOW = 4096
END_ID = 2
GROUP_WINDOWS = 32
#: Distinct pieces of words a worker remembers the ids of.
CACHE_PIECES = 1_200_000

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long"
)


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable characters of Latin-1 stand for themselves, the rest follow from 256 on.
    """
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, extra = [], 256
    for byte in range(256):
        letters.append(chr(byte if byte in own else extra))
        extra += byte not in own
    return letters


#: The normaliser and the cutting that _PIECES and _PLAIN stand for.
_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
_CUTTING = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: How the vocabulary cuts lower-case text made of the characters of _PLAIN only.
_PIECES = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
_PLAIN = re.compile(r"[\t\n\r\x20-\x7eß-öø-ÿÀ-ÖØ-Þ]*")


class WordTokenizer:
    """Ids of texts, piece by piece; equal to encoding whole texts.

    The tokenizer lower-cases, cuts at its pattern, drops white space, and
    merges inside each piece alone. Text of plain letters is cut here, and ids of
    pieces met before come from a cache; new ones go to the merge model. Words
    with any other character, and the special tokens, go through the whole
    tokenizer, word by word: no piece spans white space. A vocabulary with other
    rules is left to the whole tokenizer, text by text.
    """

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = byte_letters()
        parts = (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)
        self.known_rules = [part and json.loads(part.__getstate__()) for part in parts] == [_NORMALIZER, _CUTTING]
        self.pieces: dict[str, bytes] = {}
        self.cache_pieces = cache_pieces

    def _plain(self, text: str) -> bool:
        special = "<|" in text and any(s in text for s in self.specials)
        return not special and _PLAIN.fullmatch(text) is not None

    def _cut(self, pieces: list[str]) -> bytes:
        known = self.pieces
        try:
            return b"".join([known[piece] for piece in pieces])
        except KeyError:
            pass
        if len(known) > self.cache_pieces:
            known.clear()
        tokenize = self.tokenizer.model.tokenize
        for piece in pieces:
            if piece not in known:
                spelt = piece
                if not piece.isascii():
                    spelt = "".join(map(self.letters.__getitem__, piece.encode()))
                known[piece] = array("I", [token.id for token in tokenize(spelt)]).tobytes()
        return b"".join([known[piece] for piece in pieces])

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text."""
        if not self.known_rules:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if self._plain(text):
            return self._cut(_PIECES.findall(text.lower()))
        out = []
        # Only these are cut at: they are white space to every part of the
        # tokenizer, and no character composes across them.
        for word in re.split("[\t\n\r ]+", text):
            if self._plain(word):
                out.append(self._cut(_PIECES.findall(word.lower())))
            else:
                ids = self.tokenizer.encode(word, add_special_tokens=False).ids
                out.append(array("I", ids).tobytes())
        return b"".join(out)


def worker_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer, with its cache, for all tasks of a Python worker."""
    kept = sys.modules.setdefault("_ridemetrics_tokenizers", types.ModuleType("_ridemetrics_tokenizers"))
    if path not in kept.__dict__:
        kept.__dict__[path] = WordTokenizer(path)
    return kept.__dict__[path]


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Indices of `sizes` dealt to `windows` parts with nearly equal sums."""
    heap = []
    for i, size in enumerate(sizes):
        # loads in falling order beside the members of each; parts not named are empty
        heap.append((-size if windows > 1 else 0, i, [size], [[i]]))
    heapq.heapify(heap)
    order = len(sizes)
    while len(heap) > 1:
        _, _, loads_a, parts_a = heapq.heappop(heap)
        _, _, loads_b, parts_b = heapq.heappop(heap)
        loads_b = loads_b + [0] * (windows - len(loads_b))
        parts_b = parts_b + [[]] * (windows - len(parts_b))
        loads_b.reverse()
        parts_b.reverse()
        pad = windows - len(loads_a)
        loads_a, parts_a = loads_a + [0] * pad, parts_a + [[]] * pad
        sums = [a + b for a, b in zip(loads_a, loads_b)]
        rank = sorted(range(windows), key=sums.__getitem__, reverse=True)
        loads = [sums[r] for r in rank]
        parts = [parts_a[r] + parts_b[r] if parts_b[r] else parts_a[r] for r in rank]
        while loads and loads[-1] == 0 and not parts[-1]:
            loads.pop()
            parts.pop()
        spread = loads[0] - (loads[-1] if len(loads) == windows else 0)
        heapq.heappush(heap, (-spread, order, loads, parts))
        order += 1
    parts = heap[0][3] if heap else []
    return parts + [[] for _ in range(windows - len(parts))]


#: A piece of a document: its number, where it starts there, its length.
Piece = tuple[int, int, int]


def pack_group(lengths: list[int], window: int = WINDOW, last: bool = True) -> tuple[list[list[Piece]], list[Piece]]:
    """Windows of pieces over documents of these lengths, and the pieces left over.

    All windows are full, and less than a window is left over; of the last group
    that comes in windows of a power of two of tokens, and nothing is left.
    """
    full: list[list[Piece]] = []
    rest: list[Piece] = []
    for doc, length in enumerate(lengths):
        whole = length // window
        full.extend([(doc, k * window, window)] for k in range(whole))
        if length % window:
            rest.append((doc, whole * window, length % window))
    total = sum(piece[2] for piece in rest)
    if not total:
        return full, []
    count = -(-total // window)
    dealt = [[rest[i] for i in part] for part in difference([p[2] for p in rest], count)]
    # Capacities: whole windows, then the remainder, at the end in powers of two.
    remainder = total % window
    capacity = [window] * (total // window)
    capacity += [1 << b for b in range(window.bit_length() - 1, -1, -1) if remainder >> b & 1] if last else [remainder]
    windows: list[list[Piece]] = []
    over: list[Piece] = []
    free: list[int] = []
    for k, room in enumerate(capacity):
        kept = []
        for doc, start, length in dealt[k] if k < count else []:
            take = min(length, room)
            if take:
                kept.append((doc, start, take))
                room -= take
            if take < length:
                over.append((doc, start + take, length - take))
        windows.append(kept)
        free.append(room)
    # Pieces that a smaller last window has no part in.
    over += [piece for part in dealt[len(capacity) :] for piece in part]
    k = 0
    for doc, start, length in over:
        while length:
            while not free[k]:
                k += 1
            take = min(length, free[k])
            windows[k].append((doc, start, take))
            free[k] -= take
            start, length = start + take, length - take
    left = [] if last else windows.pop()
    return full + windows, left


def _packer(path: str, window: int, group_windows: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_tokenizer(path)
        base = TaskContext.get().partitionId() << 32
        sequence = 0
        # doc_id, its tokens in all, where these tokens start in it, these tokens
        waiting: list[tuple[int, int, int, bytes]] = []
        held = 0

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal sequence, held
            out: list[tuple] = []
            windows, left = pack_group([len(data) // 4 for *_, data in waiting], window, last)
            for pieces in windows:
                offset = 0
                for entry, at, length in pieces:
                    doc_id, doc_tokens, start, data = waiting[entry]
                    crc = zlib.crc32(memoryview(data)[4 * at : 4 * (at + length)])
                    out.append((doc_id, start + at, length, crc, doc_tokens, base + sequence, offset))
                    offset += length
                sequence += 1
            carried = []
            for entry, at, length in left:
                doc_id, doc_tokens, start, data = waiting[entry]
                carried.append((doc_id, doc_tokens, start + at, data[4 * at : 4 * (at + length)]))
            waiting[:] = carried
            held = sum(len(data) // 4 for *_, data in carried)
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            table = np.array(out, np.int64).reshape(-1, len(names))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(table[:, i])) for i in range(len(names))], names
            )

        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for doc_id, text in zip(doc_ids, texts):
                data = encoder.encode(text.as_py()) + end
                waiting.append((doc_id, len(data) // 4, 0, data))
                held += len(data) // 4
                if held >= group_windows * window:
                    yield flush(last=False)
        if waiting:
            yield flush(last=True)

    return pack


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    group_windows: int = GROUP_WINDOWS,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece of a document, see SCHEMA.

    Each document is its ids and then `end_id`; a NULL or empty text is that one
    id. Every id lies in exactly one piece and pieces fill their sequence from 0
    without gaps. Sequences hold `window` ids, so none needs padding; the last of
    each task hold a power of two. A row that comes twice is packed twice; a NULL id stays NULL.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    rows = keyed(docs, id_col, text_col).select("doc_id", "text")
    packed = rows.mapInArrow(_packer(tokenizer_path, window, group_windows, end_id), SCHEMA)
    return packed.withColumn("doc_id", public_id())
