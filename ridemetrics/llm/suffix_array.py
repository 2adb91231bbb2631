"""Suffix and common-prefix arrays of a set of byte strings by external induced sorting.

Suffixes that start a local minimum are sorted first: their substrings are
named by a first induction, and the string of names, a third as long, is sorted
in turn. From them the order of all others follows: whoever precedes a sorted
suffix by one symbol is pushed to the queue of that symbol, with the length of
the prefix it shares with the one pushed before it. Symbols are taken in rising
order for the suffixes that fall, then in falling order for those that rise.

Pushes to a symbol arrive in their final order, so the priority queue is one
first-in-first-out lane per symbol. Lanes spill to a file of the task when they
hold more than `memory` entries. The text, a few bytes for each of its places and
the sorted entries are held in memory; shards are made small enough for that.

Symbol 0 ends a string. Ends are smaller than all else and differ from each
other (earlier is smaller), so no common prefix runs over them.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Entries that the lanes of a queue keep in memory.
QUEUE_MEMORY = 8_000_000
#: Largest alphabet that is sorted by induction; above it the lanes get too many.
MOST_SYMBOLS = 2048

_ENTRY = np.dtype([("at", np.int64), ("shared", np.uint8)])


class LaneQueue:
    """A priority queue by (symbol, arrival); what does not fit in memory lies in a file."""

    def __init__(self, symbols: int, memory: int) -> None:
        self.lanes: list[list] = [[] for _ in range(symbols)]
        self.memory, self.held = memory, 0
        self.file = None

    def push(self, symbol: int, entries: np.ndarray) -> None:
        self.lanes[symbol].append(entries)
        self.held += len(entries)
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile(prefix="lanes-")
        self.file.seek(0, 2)
        for lane in self.lanes:
            for i, part in enumerate(lane):
                if isinstance(part, np.ndarray):
                    lane[i] = (self.file.tell(), len(part))
                    self.file.write(part.tobytes())
        self.held = 0

    def pop(self, symbol: int):
        """Parts of the lane of a symbol in arrival order; pushes to it meanwhile come too."""
        lane = self.lanes[symbol]
        done = 0
        while done < len(lane):
            parts, size = [], 0
            while done < len(lane) and size < self.memory:
                part, lane[done] = lane[done], None
                done += 1
                if isinstance(part, tuple):
                    self.file.seek(part[0])
                    part = np.frombuffer(self.file.read(part[1] * _ENTRY.itemsize), _ENTRY)
                else:
                    self.held -= len(part)
                parts.append(part)
                size += len(part)
            yield np.concatenate(parts)
        self.lanes[symbol] = []

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class _Shared:
    """The least common prefix since the last push to each symbol."""

    def __init__(self, symbols: int, most: int) -> None:
        self.most = most
        self.since = np.full(symbols, most, np.uint8)

    def of_pushes(self, shared: np.ndarray, where: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """For pushes made at places `where` of a batch, sorted by (symbol, where)."""
        table = [shared]
        while 2 << (len(table) - 1) <= len(shared):
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        flat = np.concatenate(table)
        base = np.cumsum([0] + [len(t) for t in table[:-1]])
        new = np.r_[True, symbol[1:] != symbol[:-1]]
        begin = np.where(new, 0, np.r_[0, where[:-1] + 1])
        level = np.log2(where - begin + 1).astype(np.int64)
        least = np.minimum(flat[base[level] + begin], flat[base[level] + where + 1 - (1 << level)])
        least[new] = np.minimum(least[new], self.since[symbol[new]])
        # What has passed since, for every symbol.
        tail = np.minimum.accumulate(np.r_[np.uint8(self.most), shared[::-1]])[::-1]
        np.minimum(self.since, tail[0], out=self.since)
        last = np.r_[new[1:], True]
        self.since[symbol[last]] = tail[where[last] + 1]
        return np.minimum(least, self.most - 1) + np.uint8(1)


class _Induction:
    def __init__(self, text: np.ndarray, symbols: int, most: int, memory: int) -> None:
        self.text, self.symbols, self.most, self.memory = text, symbols, most, memory
        n = len(text)
        follows = np.r_[text[1:], -1]
        # Rising: smaller than the suffix after it. Ends rise; equals take the next one's.
        differ = text != follows
        differ[-1] = True
        rises = (text < follows) | (text == 0)
        place = np.flatnonzero(differ | (text == 0))
        run_end = place[np.searchsorted(place, np.arange(n))]
        self.rising = rises[run_end]
        self.run = run_end - np.arange(n) + 1
        lms = self.rising.copy()
        lms[0] = text[0] == 0
        lms[1:] &= ~self.rising[:-1]
        self.minima = np.flatnonzero(lms)

    def _visit(self, queue: LaneQueue, shared: _Shared | None, entries: np.ndarray, rising: bool) -> None:
        """Push who precedes the entries by one symbol and is of the wanted kind."""
        at = entries["at"]
        before = at - 1
        fits = at > 0
        fits[fits] = (self.rising[before[fits]] == rising) & (self.text[before[fits]] != 0)
        where = np.flatnonzero(fits)
        if not len(where):
            if shared is not None and len(entries):
                np.minimum(shared.since, entries["shared"].min(), out=shared.since)
            return
        symbol = self.text[before[where]].astype(np.int64)
        order = np.argsort(symbol, kind="stable")
        symbol, where = symbol[order], where[order]
        pushed = np.empty(len(where), _ENTRY)
        pushed["at"] = before[where]
        pushed["shared"] = 0 if shared is None else shared.of_pushes(entries["shared"], where, symbol)
        starts = np.flatnonzero(np.r_[True, symbol[1:] != symbol[:-1]])
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(symbol)]):
            queue.push(int(symbol[a]), pushed[a:b])

    def _seam(self, a: int, b: int) -> int:
        """Common prefix of a falling and a rising suffix of one symbol."""
        return min(int(self.run[a]), int(self.run[b]), self.most)

    def falling(self, seeds: np.ndarray, with_shared: bool) -> list[np.ndarray]:
        """The falling suffixes of each symbol in order, from sorted minima."""
        queue = LaneQueue(self.symbols, self.memory)
        shared = _Shared(self.symbols, self.most) if with_shared else None
        bounds = np.searchsorted(self.text[seeds["at"]], np.arange(self.symbols + 1))
        found: list[np.ndarray] = []
        for c in range(self.symbols):
            parts = []
            for part in queue.pop(c):
                if not parts:
                    part["shared"][0] = 0
                parts.append(part)
                self._visit(queue, shared, part, rising=False)
            found.append(np.concatenate(parts) if parts else np.zeros(0, _ENTRY))
            own = seeds[bounds[c] : bounds[c + 1]]
            if len(own):
                own = own.copy()
                own["shared"][0] = self._seam(parts[-1]["at"][-1], own["at"][0]) if parts and c else 0
                self._visit(queue, shared, own, rising=False)
        queue.close()
        return found

    def all_sorted(self, falling: list[np.ndarray], ends: np.ndarray, with_shared: bool) -> np.ndarray:
        """Every suffix in order, with the prefix shared with the one before it."""
        queue = LaneQueue(self.symbols, self.memory)
        shared = _Shared(self.symbols, self.most) if with_shared else None
        out: list[np.ndarray] = []
        for c in range(self.symbols - 1, 0, -1):
            # Going down, an entry's shared prefix is with the one after it.
            parts = []
            for part in queue.pop(c):
                if not parts:
                    part["shared"][0] = 0
                parts.append(part)
                self._visit(queue, shared, part, rising=True)
            rising = np.concatenate(parts)[::-1] if parts else np.zeros(0, _ENTRY)
            down = falling[c][::-1].copy()
            if len(down):
                down["shared"][1:] = down["shared"][:-1].copy()
                down["shared"][0] = self._seam(down["at"][0], rising["at"][0]) if len(rising) else 0
                self._visit(queue, shared, down, rising=True)
            # In rising order, with the one before.
            up = rising.copy()
            if len(up):
                up["shared"][1:] = rising["shared"][:-1]
                up["shared"][0] = self._seam(falling[c]["at"][-1], up["at"][0]) if len(falling[c]) else 0
            out += [up, falling[c]]
        first = np.zeros(len(ends), _ENTRY)
        first["at"] = ends
        out.append(first)
        queue.close()
        return np.concatenate(out[::-1])


def shared_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and at b, `most` at most."""
    padded = np.r_[text, np.zeros(most + 1, text.dtype)]
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for k in range(most):
        x = padded[a[live] + k]
        live = live[(x == padded[b[live] + k]) & (x != 0)]
        if not len(live):
            break
        out[live] = k + 1
    return out


def _doubling(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names; zeros differ by place. Sorts by doubled prefixes."""
    n = len(names)
    zeros = np.flatnonzero(names == 0)
    rank = names.astype(np.int64) + len(zeros)
    rank[zeros] = np.arange(len(zeros))
    step = 1
    while True:
        # Beyond an end nothing counts: the end itself is unique.
        key = rank * np.int64(n + len(zeros) + int(names.max()) + 2)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        changes = key[order][1:] != key[order][:-1]
        new[order] = np.r_[0, np.cumsum(changes)]
        rank = new
        if changes.all():
            return order
        step *= 2


def suffix_order(text: np.ndarray, symbols: int, most: int, memory: int = QUEUE_MEMORY) -> np.ndarray:
    """Entries (at, shared) of all suffixes of `text` in order; the text ends with 0.

    shared is the length of the prefix common with the entry before, `most` (255
    or less) at most.
    """
    work = _Induction(text, symbols, most, memory)
    minima = work.minima
    ends = np.flatnonzero(text == 0)
    # First induction, from minima in no order within a symbol: it sorts their substrings.
    seeds = np.zeros(len(minima), _ENTRY)
    seeds["at"] = minima[np.argsort(text[minima], kind="stable")]
    rough = work.all_sorted(work.falling(seeds, False), ends, False)["at"]
    slot = np.full(len(text), -1, np.int64)
    slot[minima] = np.arange(len(minima))
    listed = slot[rough]
    listed = listed[listed >= 0]
    names = _name_substrings(text, minima, listed)
    final = int(names.max()) + 1
    if final == 1:
        order = np.arange(len(minima))
    elif len(np.unique(names[names > 0])) == int((names > 0).sum()):
        key = names.copy()
        key[names == 0] = np.arange(int((names == 0).sum())) - len(names)
        order = np.argsort(key, kind="stable")
    elif final <= MOST_SYMBOLS and len(minima) < len(text):
        order = suffix_order(names, final, 1, memory)["at"]
    else:
        order = _doubling(names)
    seeds = np.zeros(len(minima), _ENTRY)
    seeds["at"] = minima[order]
    if most > 1:
        seeds["shared"][1:] = shared_prefix(text, seeds["at"][:-1], seeds["at"][1:], most)
    return work.all_sorted(work.falling(seeds, True), ends, True)


def _name_substrings(text: np.ndarray, minima: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Names of the minima's substrings, in their order; ends are all named 0."""
    stop = np.r_[minima[1:], len(text) - 1]
    length = stop - minima
    length[text[minima] == 0] = 0
    at, size = minima[listed], length[listed]
    same = np.zeros(len(listed), bool)
    if len(listed) > 1:
        live = np.flatnonzero(size[1:] == size[:-1]) + 1
        k = 0
        while len(live):
            equal = text[at[live] + k] == text[at[live - 1] + k]
            live = live[equal]
            over = size[live] == k
            same[live[over]] = True
            live = live[~over]
            k += 1
    is_end = text[at] == 0
    names_sorted = np.cumsum(~same & ~is_end)
    names_sorted[is_end] = 0
    names = np.empty(len(listed), np.int64)
    names[listed] = names_sorted
    return names


def sorted_suffixes(strings: list[bytes], most: int, memory: int = QUEUE_MEMORY):
    """(string, offset, shared) of all suffixes of the strings, ends left out, in order."""
    lengths = np.array([len(s) for s in strings], np.int64)
    text = np.zeros(int(lengths.sum()) + len(strings), np.int32)
    begins = np.cumsum(np.r_[0, lengths[:-1] + 1]) if len(strings) else np.zeros(0, np.int64)
    body = np.ones(len(text), bool)
    body[begins + lengths] = False
    text[body] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int32) + 1
    if not len(strings):
        none = np.zeros(0, np.int64)
        return none, none, none
    found = suffix_order(text, 257, most, memory)[len(strings) :]
    which = np.searchsorted(begins, found["at"], side="right") - 1
    return which, found["at"] - begins[which], found["shared"].astype(np.int64)
