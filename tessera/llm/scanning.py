"""Byte classes and words of texts, scanned in the buffers of an Arrow column.

The bytes of a slice of rows are looked up in one table of class bits; prefix sums of each
class, read at the rows' offsets, count it for every row. Words are runs of anything but
space, tab, newline, vertical tab, form feed and return. Each gets a hash of its bytes,
taken eight at a time; hashes are sorted inside their row, and neighbours of one hash are
compared byte by byte, so numbers of distinct words are exact.

Slices hold about SLICE bytes of whole rows, and class arrays CHUNK bytes, so memory is
bounded by these and by the words of the longest text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SPACES = b" \t\n\x0b\x0c\r"
SLICE, CHUNK, ROWS = 4 << 20, 256 << 10, 4096
#: Longer words are hashed and compared one by one.
LONG = 256
MIX = np.uint64(0x9E3779B97F4A7C15)
LANE_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


class Scan:
    """Rows of a slice: `counts` of each class and of code points (chars), and their words.

    start, end: places of the words in data; row: the row of each; n_words: of each row.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, classes: dict[str, bytes]):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        names = ["chars", *classes]
        table = np.zeros(256, np.uint32)
        table[[x for x in range(256) if x & 0xC0 != 0x80]] |= 2
        table[list(SPACES)] |= 1
        for k, chosen in enumerate(classes.values(), 2):
            table[list(chosen)] |= 1 << k
        totals, so_far = np.zeros((len(names), self.n + 1), np.int64), np.zeros(len(names), np.int64)
        starts, ends, before = [], [], True
        first, last = int(offsets[0]), int(offsets[-1])
        for low in range(first, last, CHUNK):
            high = min(low + CHUNK, last)
            flags = table[data[low:high]]
            here = slice(*np.searchsorted(offsets, [low, high], side="right"))  # offsets in (low, high]
            at = offsets[here] - low
            for k in range(len(names)):
                sums = np.cumsum((flags >> np.uint32(k + 1)) & np.uint32(1), dtype=np.int32)
                totals[k, here] = so_far[k] + sums[at - 1]
                so_far[k] += sums[-1]
            space = (flags & 1).astype(bool)
            cut = np.zeros(high - low + 1, bool)  # a row begins here
            cut[at] = True
            cut[0] = low == offsets[here.start - 1]
            led = np.concatenate([[before], space[:-1]]) | cut[:-1]
            starts.append(np.flatnonzero(~space & led) + low)
            after = np.append(space[1:], (high == last) or data[high] in SPACES) | cut[1:]
            ends.append(np.flatnonzero(~space & after) + low + 1)
            before = bool(space[-1])
        self.start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        bounds = np.searchsorted(self.start, offsets)
        self.n_words = np.diff(bounds)
        self.row = np.repeat(np.arange(self.n), self.n_words)
        self.counts = dict(zip(names, np.diff(totals, axis=1), strict=True))
        self.lengths = self.end - self.start

    def lanes(self, which: np.ndarray, k: int) -> np.ndarray:
        """Bytes 8k to 8k + 7 of words, zeros behind their ends."""
        raw = self.data
        inside = np.minimum(self.lengths[which] - 8 * k, 8)
        at = self.start[which] + 8 * k
        if len(raw) < 8:
            raw, back = np.concatenate([raw, np.zeros(8, np.uint8)]), np.zeros(len(at), np.int64)
        else:
            back = np.maximum(at - (len(raw) - 8), 0)
        eight = np.ndarray(len(raw) - 7, "<u8", raw, 0, (1,))
        return (eight[at - back] >> (8 * back).astype(np.uint64)) & LANE_MASK[inside]

    def hashes(self) -> np.ndarray:
        """64 bits of each word's bytes."""
        h = self.lengths.astype(np.uint64) * MIX
        todo, k = np.flatnonzero(self.lengths <= LONG), 0
        while len(todo):
            x = (h[todo] ^ self.lanes(todo, k)) * MIX
            h[todo] = (x ^ (x >> np.uint64(29))) * MIX
            k += 1
            todo = todo[self.lengths[todo] > 8 * k]
        for i in np.flatnonzero(self.lengths > LONG):
            h[i] = xxhash.xxh64_intdigest(self.data[self.start[i] : self.end[i]])
        return h ^ (h >> np.uint64(32))

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words a and b are the same, pair by pair."""
        same = self.lengths[a] == self.lengths[b]
        todo, k = np.flatnonzero(same & (self.lengths[a] <= LONG)), 0
        while len(todo):
            same[todo] = self.lanes(a[todo], k) == self.lanes(b[todo], k)
            k += 1
            todo = todo[same[todo] & (self.lengths[a[todo]] > 8 * k)]
        for i in np.flatnonzero(same & (self.lengths[a] > LONG)):
            x, y = (self.data[self.start[w] : self.end[w]] for w in (a[i], b[i]))
            same[i] = np.array_equal(x, y)
        return same

    def groups(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words sorted by row and hash, whether each begins a group of equal words in its row)."""
        keys = (self.row.astype(np.uint64) << np.uint64(52)) | (hashes >> np.uint64(12))
        order = np.argsort(keys)
        new = np.ones(len(order), bool)
        new[1:] = keys[order][1:] != keys[order][:-1]
        pair = np.flatnonzero(~new)
        wrong = pair[~self.equal(order[pair - 1], order[pair])]
        for r in np.unique(self.row[order[wrong]]):  # two words of one hash: that row by its words themselves
            here = np.flatnonzero(self.row[order] == r)
            words = [self.data[self.start[w] : self.end[w]].tobytes() for w in order[here]]
            again = sorted(range(len(here)), key=words.__getitem__)
            order[here] = order[here][again]
            new[here] = [k == 0 or words[again[k]] != words[again[k - 1]] for k in range(len(here))]
        return order, new

    def distinct(self, hashes: np.ndarray | None = None) -> np.ndarray:
        """Number of different words of each row."""
        order, new = self.groups(self.hashes() if hashes is None else hashes)
        return np.bincount(self.row[order[new]], minlength=self.n)


def scans(column: pa.Array, classes: dict[str, bytes]) -> Iterator[Scan]:
    """The rows of a string column (null: empty) in slices."""
    text = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    raw = text.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    low = 0
    while low < len(text):
        high = int(np.searchsorted(offsets, offsets[low] + SLICE, side="right")) - 1
        high = min(max(high, low + 1), low + ROWS, len(text))
        yield Scan(data, offsets[low : high + 1], classes)
        low = high


def together(parts: Iterable[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *parts])
