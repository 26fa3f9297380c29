"""Array views of batches of texts: bytes, words and hashes, without a Python object per word."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_libc = ctypes.CDLL(None)

#: Texts are handled in groups of about so many bytes; one longer text is a group of its own.
CHUNK_BYTES = 2_000_000

#: The bytes that part words, 0x20 and 0x09 to 0x0D.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Masks that keep the first 0 to 8 bytes of a block of 8.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of the rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``limit`` bytes of text."""
    n = batch.num_rows
    if not n:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, start = np.cumsum(size), 0
    while start < n:
        base = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop
    trim()


def trim() -> None:
    """Give freed memory back to the system: a worker that is used again would hold its largest batch's share for good."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def tidied(run):
    """``run`` over a task's batches, which gives back what it held when it ends: Spark lets idle workers take turns, so each of
    them would hold its last task's share.  ``trim`` in the run itself comes before its last arrays go.
    """

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return whole


def pieces(texts: list[str], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Texts in arrays of about ``limit`` characters, each with the place of its first one."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, pa.array(texts[start:i], pa.string())
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, pa.array(texts[start:], pa.string())


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and n + 1 offsets of the rows into them."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~IS_SPACE[data]
    filled = offsets[1:] > offsets[:-1]
    first = np.empty(len(data), bool)
    first[0], first[1:] = True, ~solid[:-1]
    first[offsets[:-1][filled]] = True
    last = np.empty(len(data), bool)
    last[-1], last[:-1] = True, ~solid[1:]
    last[offsets[1:][filled] - 1] = True
    starts = np.flatnonzero(solid & first)
    return starts, np.flatnonzero(solid & last) + 1, np.searchsorted(starts, offsets)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans; those of different seeds are independent.

    A span is cut into blocks of 8 bytes.  Each block is mixed with its place in the span before the blocks are summed, so that
    no pattern of equal or swapped parts cancels out; spans of one length of up to 8 bytes never collide.
    """
    size = ends - starts
    blocks = (size + 7) >> 3
    stop = np.cumsum(blocks)
    owner_start = np.repeat(starts - 8 * (stop - blocks), blocks)
    at = owner_start + 8 * np.arange(int(stop[-1]) if len(stop) else 0)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    value = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))[at]
    value &= _KEEP[np.minimum(np.repeat(ends, blocks) - at, 8)]
    place = (at - np.repeat(starts, blocks)).astype(np.uint64) + np.uint64(8 + (seed << 40))
    value ^= mixed(place * _ODD)
    total = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(mixed(value), out=total[1:], dtype=np.uint64)
    return mixed(total[stop] - total[stop - blocks] + size.astype(np.uint64) * _ODD)


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The row of each item, from the n + 1 offsets of the rows."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def crc32_rows(ids: np.ndarray) -> np.ndarray:
    """crc32 of the decimal text of each id."""
    import zlib

    return np.array([zlib.crc32(str(int(x)).encode()) for x in ids], np.int64)


class Collision(Exception):
    """Two different spans have the same first hash."""


class SpanCache:
    """Ids of byte spans by hash, kept from batch to batch: a large sorted part, and a small one that is merged into it now and then.

    A span is known by two independent hashes of 64 bits: it is looked up by the first, and the second must agree, else
    :class:`Collision` is raised and the caller encodes its spans without the cache.  Over ``limit`` different
    spans it begins anew, so its memory is bounded.
    """

    def __init__(self, limit: int) -> None:
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        none = np.zeros(0, np.int64)
        self.parts = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), none, none) for _ in range(2)]
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0

    @staticmethod
    def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and second hashes of the different spans, where each is first met, and which of them every span is."""
        keys, place, back = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        second = span_hashes(data, starts, ends, 1)
        if (second != second[place][back]).any():
            raise Collision
        return keys, second[place], place, back

    def _find(self, keys: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin, size = np.zeros(len(keys), np.int64), np.full(len(keys), -1, np.int64)
        for known, check, at, lens in self.parts:
            if len(known):
                where = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[where] == keys
                if (check[where[hit]] != second[hit]).any():
                    raise Collision
                begin[hit], size[hit] = at[where[hit]], lens[where[hit]]
        return begin, size

    def missing(self, keys: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Which of the keys are not kept."""
        return np.flatnonzero(self._find(keys, second)[1] < 0)

    def insert(self, keys: np.ndarray, second: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
        """Keep the ids of different keys that are not kept yet; ``at`` has n + 1 offsets."""
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool[: self.used], np.zeros(self.used + 2 * len(ids), np.int32)))
        self.pool[self.used : self.used + len(ids)] = ids
        self._add(keys, second, self.used + at[:-1], np.diff(at))
        self.used += len(ids)

    def take(self, keys: np.ndarray, second: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the spans one after another, and n + 1 offsets."""
        begin, size = self._find(keys, second)
        lens = size[back]
        stop = np.cumsum(lens)
        total = int(stop[-1]) if len(stop) else 0
        return self.pool[np.arange(total) + np.repeat(begin[back] - stop + lens, lens)], np.concatenate(([0], stop))

    def make_room(self, n: int) -> None:
        """Begin anew if ``n`` more keys would be over the limit; keys found before are then no longer kept."""
        if sum(len(p[0]) for p in self.parts) + n > self.limit:
            self._clear()

    def lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all spans one after another, and n + 1 offsets; ``encode(starts, ends)`` gives both for spans not met before."""
        try:
            keys, second, place, back = self.distinct(data, starts, ends)
            self.make_room(len(keys))
            fresh = self.missing(keys, second)
        except Collision:
            return encode(starts, ends)
        if len(fresh):
            self.insert(keys[fresh], second[fresh], *encode(starts[place[fresh]], ends[place[fresh]]))
        return self.take(keys, second, back)

    def _add(self, *new: np.ndarray) -> None:
        small = [np.concatenate(x) for x in zip(self.parts[1], new)]
        if len(small[0]) > max(50_000, len(self.parts[0][0]) // 4):
            whole = [np.concatenate(x) for x in zip(self.parts[0], small)]
            order = np.argsort(whole[0])
            self.parts = [tuple(x[order] for x in whole), tuple(x[:0] for x in whole)]
        else:
            order = np.argsort(small[0])
            self.parts[1] = tuple(x[order] for x in small)
