"""Byte-level BPE by a hierarchical-bitmap rank queue, over all different pre-tokens of a batch at once."""

from __future__ import annotations

import base64
import hashlib
import itertools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

#: The code points of White_Space.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: The endings that stand alone after an apostrophe.
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")
#: A task keeps the ids of so many pre-tokens (some 40 bytes each) from one group of texts to the next.
CACHE = 1_000_000
#: Rows go to the workers in Arrow batches of about so many bytes.
BATCH_BYTES = 8_000_000
#: Texts are handled in groups of about so many bytes: the arrays over a group take some 60 bytes for each of them.
CHUNK = 1_000_000
#: Groups of texts whose new pre-tokens go through one queue.
GROUP = 4

#: The session's setting for BATCH_BYTES.
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
_state: dict = {}


class RankQueue:
    """Positions in buckets by merge rank, and a bitmap over the ranks that have any, in levels up to a single word.

    A bit of a higher level is set if the word below it is not 0; the next rank is found by a find-first-set step a level.
    """

    def __init__(self, ranks: int) -> None:
        self.levels = [[0] * (-(-ranks // 64) or 1)]
        while len(self.levels[-1]) > 1:
            self.levels.append([0] * -(-len(self.levels[-1]) // 64))
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        for rank, part in zip(ranks[np.concatenate(([0], cuts))].tolist() if len(ranks) else (), np.split(positions, cuts)):
            if rank in self.buckets:
                self.buckets[rank].append(part)
                continue
            self.buckets[rank] = [part]
            for level in self.levels:
                level[rank >> 6] |= 1 << (rank & 63)
                rank >>= 6

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The lowest rank and its positions, ascending; some of them may be stale."""
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            if not word:
                return None
            at = (at << 6) | ((word & -word).bit_length() - 1)
        rank, parts = at, self.buckets.pop(at)
        for level in self.levels:
            level[at >> 6] &= ~(1 << (at & 63))
            if level[at >> 6]:
                break
            at >>= 6
        return rank, np.unique(np.concatenate(parts)) if len(parts) > 1 else np.sort(parts[0])


class Vocabulary:
    """Ranks of byte strings, and the rank that a pair of tokens merges to."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            pairs = (line.split() for line in f if line.strip())
            self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        size = max(self.ranks.values()) + 1
        self.tokens = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.size = size
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        keys, merged = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * size + right)
                    merged.append(rank)
        order = np.argsort(np.array(keys))
        self.keys, self.merged = np.array(keys)[order], np.array(merged)[order]
        self.pairs = dict(zip(self.keys.tolist(), self.merged.tolist()))
        bits = 22
        self.sieve, self.mask = np.zeros(1 << bits, bool), (1 << bits) - 1
        self.sieve[self._spread(self.keys)] = True
        lens = np.array([len(t) for t in self.tokens])
        self.blob, self.blob_at = np.frombuffer(b"".join(self.tokens), np.uint8), np.concatenate(([0], np.cumsum(lens)))

    def _spread(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * 0x9E3779B1) >> 11) & self.mask

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, -1 where there is none."""
        key = left.astype(np.int64) * self.size + right
        out = np.full(len(key), -1, np.int64)
        maybe = np.flatnonzero(self.sieve[self._spread(key)])
        if len(maybe):
            key = key[maybe]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[maybe] = np.where(self.keys[place] == key, self.merged[place], -1)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        lens = self.blob_at[ids + 1] - self.blob_at[ids]
        start = np.cumsum(lens) - lens
        return self.blob[np.arange(int(lens.sum())) + np.repeat(self.blob_at[ids] - start, lens)].tobytes()


def encode_one(vocab: Vocabulary, piece: bytes) -> list[int]:
    """One pre-token by the rank queue, one merge at a time: lowest rank first, leftmost first; stale positions are skipped."""
    ids = vocab.byte[np.frombuffer(piece, np.uint8)].tolist()
    nxt, prv = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
    live, size, end = [True] * len(ids), vocab.size, len(ids)
    queue = RankQueue(size)
    ranks = vocab.rank(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64))
    queue.push(ranks[ranks >= 0], np.flatnonzero(ranks >= 0))

    def pair(i):
        return vocab.pairs.get(ids[i] * size + ids[nxt[i]], -1) if i >= 0 and nxt[i] < end else -1

    while (popped := queue.pop()) is not None:
        rank, positions = popped
        # A merge may bring a lower rank, or the same one further left: what is left of the bucket then waits behind it.
        todo = positions.tolist()[::-1]
        while todo:
            i = todo.pop()
            if not live[i] or pair(i) != rank:
                continue
            j = nxt[i]
            ids[i], live[j], nxt[i] = rank, False, nxt[j]
            if nxt[i] < end:
                prv[nxt[i]] = i
            new = [(r, k) for k in (prv[i], i) if (r := pair(k)) >= 0]
            if new:
                queue.push(np.array([r for r, _ in new]), np.array([k for _, k in new]))
                if todo and min(r for r, _ in new) <= rank:
                    queue.push(np.full(len(todo), rank), np.array(todo))
                    break
    return [x for x, on in zip(ids, live) if on]


def encode_pieces(vocab: Vocabulary, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of byte spans, and n + 1 offsets into them.

    All spans lie in one linked list with breaks between them, so a bucket of the queue holds the positions of a pair
    in all spans.  Merges of one rank in different spans, or apart in a span, don't meet, and are done together; of a
    run of overlapping equal pairs every second is done, as from left to right.  Should a merge bring about a pair
    of a lower or the same rank, where the order within a span could matter, that span is encoded by itself.
    """
    n = len(starts)
    lens = ends - starts
    at = np.concatenate(([0], np.cumsum(lens)))
    total = int(at[-1])
    if not total:
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    place = np.int32 if total < 2**31 - 1 else np.int64
    ids = vocab.byte[data[np.arange(total) + np.repeat(starts - at[:-1], lens)]].astype(place)
    owner = np.repeat(np.arange(n, dtype=place), lens)
    nxt, prv = np.arange(1, total + 1, dtype=place), np.arange(-1, total - 1, dtype=place)
    nxt[at[1:][lens > 0] - 1] = -1
    prv[at[:-1][lens > 0]] = -1
    live, odd = np.ones(total, bool), np.zeros(n, bool)
    queue = RankQueue(vocab.size)
    left = np.flatnonzero(nxt >= 0).astype(place)
    r = vocab.rank(ids[left], ids[nxt[left]])
    queue.push(r[r >= 0], left[r >= 0])
    while (popped := queue.pop()) is not None:
        rank, pos = popped
        pos = pos[live[pos]]
        pos = pos[nxt[pos] >= 0]
        if not len(pos):
            continue
        pos = pos[vocab.rank(ids[pos], ids[nxt[pos]]) == rank]
        if len(pos) > 1:
            chained = nxt[pos[:-1]] == pos[1:]
            if chained.any():  # runs of overlapping pairs
                head = np.concatenate(([True], ~chained))
                step = np.arange(len(pos))
                pos = pos[(step - np.maximum.accumulate(np.where(head, step, 0))) % 2 == 0]
        if not len(pos):
            continue
        gone = nxt[pos]
        after = nxt[gone]
        ids[pos], live[gone], nxt[pos] = rank, False, after
        some = after >= 0
        prv[after[some]] = pos[some]
        look = np.unique(np.concatenate((pos[some], prv[pos][prv[pos] >= 0])))
        if not len(look):
            continue
        r = vocab.rank(ids[look], ids[nxt[look]])
        low = (r >= 0) & (r <= rank)
        if low.any():
            odd[owner[look[low]]] = True
        r_ok = r >= 0
        queue.push(r[r_ok], look[r_ok])
    if odd.any():
        parts, counts = [], np.bincount(owner[live], minlength=n)
        whole, begin = ids[live], np.concatenate(([0], np.cumsum(counts)))
        for i in range(n):
            own = np.array(encode_one(vocab, data[starts[i] : ends[i]].tobytes()), np.int64) if odd[i] else whole[begin[i] : begin[i + 1]]
            parts.append(own)
            counts[i] = len(own)
        return np.concatenate(parts), np.concatenate(([0], np.cumsum(counts)))
    return ids[live], np.concatenate(([0], np.cumsum(np.bincount(owner[live], minlength=n))))


def _classes() -> np.ndarray:
    """The class of every code point, from the general categories and WHITE_SPACE."""
    if "classes" not in _state:
        first = np.array([{"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)], np.int8)
        first[list(WHITE_SPACE)] = SPACE
        _state["classes"] = first
    return _state["classes"]


def pre_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the pre-tokens of every text, and n + 1 row offsets into them.

    A pre-token is a run of letters, of numbers or of other marks, each with one space before it if there is one; an ending
    after an apostrophe that begins a pre-token; or white space, of which the last character before something else
    stands apart unless it is that one space.
    """
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    byte_at = np.flatnonzero((data & 0xC0) != 0x80)
    kind = _classes()[chars]
    row_start = np.zeros(len(chars) + 1, bool)
    row_start[np.searchsorted(byte_at, offsets)] = True
    head = row_start[:-1].copy()
    head[1:] |= kind[1:] != kind[:-1]
    # White space before something else: its last character stands apart, or goes with what follows if it is a space.
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~row_start[1:-1])
    glued = last[chars[last] == 32]
    head[last] = True
    head[glued + 1] = False
    # Endings: an apostrophe that begins a pre-token.
    quote = np.flatnonzero((chars == 39) & head)
    if len(quote):
        stop = np.concatenate((np.flatnonzero(row_start), [len(chars)]))
        limit = stop[np.searchsorted(stop, quote, "right")]
        for ending in ENDINGS:
            ok = quote + len(ending) < limit
            for j, c in enumerate(ending, 1):
                ok &= chars[np.minimum(quote + j, len(chars) - 1)] == ord(c)
            hit = quote[ok]
            for j in range(1, len(ending) + 1):
                head[hit + j] = False
            end = hit + len(ending) + 1
            head[end[end < len(chars)]] = True
    first = np.flatnonzero(head)
    starts = byte_at[first]
    return starts, np.concatenate((starts[1:], [len(data)])), np.searchsorted(starts, offsets)


def vocabulary(path: str) -> Vocabulary:
    if path not in _state:
        _state[path] = Vocabulary(path)
    return _state[path]


def encode_batches(path: str, columns: list[pa.Array]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of all texts of each column, and n + 1 row offsets into them.

    The different pre-tokens of all columns that the worker doesn't keep yet go through one queue together.
    """
    vocab = vocabulary(path)
    cache = _state.setdefault(("cache", path), T.SpanCache(CACHE))
    cut = []
    for column in columns:
        data, offsets = T.buffers(column)
        cut.append((data, *pre_tokens(data, offsets)))
    try:
        met = [cache.distinct(data, starts, ends) for data, starts, ends, _ in cut]
        cache.make_room(sum(len(x[0]) for x in met))
        fresh = [cache.missing(keys, second) for keys, second, *_ in met]
        keys, second = (np.concatenate([x[k][f] for x, f in zip(met, fresh)]) for k in (0, 1))
        some, first, back = np.unique(keys, return_index=True, return_inverse=True)
        if (second != second[first][back]).any():
            raise T.Collision
    except T.Collision:  # every pre-token for itself
        for data, starts, ends, at in cut:
            ids, span_at = encode_pieces(vocab, data, starts, ends)
            yield ids, span_at[at]
        return
    blobs, lens = [], []
    for (data, starts, ends, _), (_, _, place, _), new in zip(cut, met, fresh):
        a, n = starts[place[new]], (ends - starts)[place[new]]
        blobs.append(data[np.arange(int(n.sum())) + np.repeat(a - np.cumsum(n) + n, n)])
        lens.append(n)
    stops = np.cumsum(np.concatenate(lens))
    begins = stops - np.concatenate(lens)
    cache.insert(some, second[first], *encode_pieces(vocab, np.concatenate(blobs), begins[first], stops[first]))
    met = [(keys, second, back.astype(np.int32)) for keys, second, _, back in met]
    for (*_, at), found in zip(cut, met):
        ids, span_at = cache.take(*found)
        yield ids, span_at[at]


def encode_batch(path: str, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return next(encode_batches(path, [column]))


def _encoded(path: str, batches) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches, GROUP of them encoded at a time; an idle worker keeps neither the ranks nor the ids after them."""
    try:
        for batch in batches:
            parts = T.chunks(batch, limit=CHUNK)
            while group := list(itertools.islice(parts, GROUP)):
                yield from ((part, *found) for part, found in zip(group, encode_batches(path, [p.column("text") for p in group])))
                T.trim()
    finally:
        for key in (path, ("cache", path)):
            _state.pop(key, None)


def decode_batch(path: str, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
    vocab = vocabulary(path)
    return [vocab.decode(ids[a:b].astype(np.int64)) for a, b in zip(at[:-1], at[1:])]


def _rows(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """Ids and texts.  The session's Arrow batches hold BATCH_BYTES from here on: its own bound, 10,000 rows, is too much of long texts."""
    docs.sparkSession.conf.set(ARROW_BYTES, str(BATCH_BYTES))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)


def bpe_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", place_col: str | None = None) -> DataFrame:
    """Encode every whole text: ``id_col, ids`` (array of int), and ``place_col`` as a long if it is named.

    Null and empty texts give no ids; a pre-token of any length is one span of the queue.  Special tokens are ordinary text.
    Repeated rows get equal ids, an empty table gives an empty result, other columns are ignored.
    """
    names = ["doc_id", "ids", "place"] if place_col else ["doc_id", "ids"]

    def run(batches):
        for part, ids, at in _encoded(path, batches):
            rest = [part.column(c) for c in names[2:]]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32))), *rest], names)

    more = [F.col(place_col).cast("long").alias("place")] if place_col else []
    out = _rows(docs, id_col, text_col, *more).mapInArrow(T.tidied(run), "doc_id long, ids array<int>" + ", place long" * len(more))
    return out.toDF(id_col, "ids", *[place_col] * len(more))


def bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode again, and give ``id_col, n_tokens, ids_sha256, decoded_sha256``; cases as in :func:`bpe_tokens`."""

    def run(batches):
        for part, ids, at in _encoded(path, batches):
            wide = ids.astype("<u4")
            sha = [hashlib.sha256(wide[a:b].tobytes()).hexdigest() for a, b in zip(at[:-1], at[1:])]
            back = [hashlib.sha256(x).hexdigest() for x in decode_batch(path, ids, at)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(at)), pa.array(sha, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _rows(docs, id_col, text_col).mapInArrow(T.tidied(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("doc_id", id_col)
