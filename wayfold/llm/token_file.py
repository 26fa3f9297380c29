"""Token ids in blocks of a static range asymmetric numeral system, one frequency table for all of them."""

from __future__ import annotations

import json
import os
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from .store import new_path

#: Frequencies are scaled to a sum of 2^BITS; states are 64 bits wide and give off words of 32 bits.
BITS = 18
LOW = 1 << 31
#: A block holds whole documents up to about so many ids, in so many interleaved lanes at most, with a checkpoint every so many steps.
BLOCK_IDS, LANES, CHECKPOINT = 1 << 20, 2_048, 256
MAGIC = b"RNS1"
#: The id that ends each document.
END_ID = 2
#: A worker keeps the ids of so many word pieces (some 40 bytes each).
CACHE = 2_000_000

#: Marks that are cut from the end of a word, and tokenized by themselves.
TRAILING = b".,;:!?&%$#*|"
_TRAIL = np.zeros(256, bool)
_TRAIL[list(TRAILING)] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_state: dict = {}


# --- the code ---------------------------------------------------------------


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies of at least 1 with a sum of 2^BITS, near the proportions of ``counts``."""
    counts = np.asarray(counts, np.float64)
    room = (1 << BITS) - len(counts)
    if room < 0:
        raise ValueError(f"more than {1 << BITS} symbols")
    freq = 1 + np.floor(counts * (room / max(counts.sum(), 1.0))).astype(np.int64)
    freq[int(np.argmax(freq))] += (1 << BITS) - int(freq.sum())
    return freq


class Table:
    """A frequency table with its running sums and the symbol of every slot."""

    def __init__(self, freq: np.ndarray) -> None:
        self.freq = freq.astype(np.uint64)
        self.base = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)


def encode_block(table: Table, ids: np.ndarray) -> bytes:
    """The block's bytes: header, states, checkpoints, words and the ids' crc32.

    Id i goes to lane i mod lanes.  Ids are coded from the last step to the first; every CHECKPOINT steps the states and the
    place in the words are noted, from where a reader can begin as well.
    """
    n = len(ids)
    lanes = int(min(LANES, max(1, n // 64)))
    steps = -(-n // lanes)
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, int, np.ndarray]] = []
    count = 0
    bits, wide, low32 = np.uint64(BITS), np.uint64(32), np.uint64(0xFFFFFFFF)
    for step in range(steps - 1, -1, -1):
        s = ids[step * lanes : (step + 1) * lanes]
        f, base = table.freq[s], table.base[s]
        x = state[: len(s)]
        full = x >= (f << np.uint64(31 - BITS + 32))
        if full.any():
            out = (x[full] & low32).astype(np.uint32)
            words.append(out)
            count += len(out)
            x = np.where(full, x >> wide, x)
        div = x // f
        state[: len(s)] = (div << bits) + (x - div * f) + base
        if step and step % CHECKPOINT == 0:
            marks.append((step, count, state.copy()))
    body = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    head = struct.pack("<4sIIIIII", MAGIC, n, lanes, steps, len(body), len(marks), zlib.crc32(np.asarray(ids).astype("<u4").tobytes()))
    points = b"".join(struct.pack("<II", step, len(body) - at) + x.astype("<u8").tobytes() for step, at, x in reversed(marks))
    payload = head + state.astype("<u8").tobytes() + points + body.astype("<u4").tobytes()
    return payload + struct.pack("<I", zlib.crc32(payload))


def checkpoints(block: bytes) -> list[int]:
    """The steps from which :func:`decode_block` can begin."""
    _, _, lanes, _, _, marks, _ = struct.unpack_from("<4sIIIIII", block)
    return [0] + [struct.unpack_from("<I", block, 28 + 8 * lanes + i * (8 + 8 * lanes))[0] for i in range(marks)]


def decode_block(table: Table, block: bytes, point: int | None = None) -> np.ndarray:
    """The ids, checked against both checksums; with ``point`` only those from that checkpoint to the next one."""
    if zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("the block's bytes don't match their checksum")
    magic, n, lanes, steps, size, marks, crc = struct.unpack_from("<4sIIIIII", block)
    if magic != MAGIC:
        raise ValueError("not a block")
    at, each = 28 + 8 * lanes, 8 + 8 * lanes
    words = np.frombuffer(block, "<u4", size, at + marks * each)
    step, pos, state, stop = 0, 0, np.frombuffer(block, "<u8", lanes, 28).copy(), steps
    if point is not None:
        begins = checkpoints(block)
        stop = begins[point + 1] if point + 1 < len(begins) else steps
        if point:
            step, pos = struct.unpack_from("<II", block, at + (point - 1) * each)
            state = np.frombuffer(block, "<u8", lanes, at + (point - 1) * each + 8).copy()
    out = np.empty(min(stop * lanes, n) - step * lanes, np.uint32)
    first, mask, bits = step * lanes, np.uint64((1 << BITS) - 1), np.uint64(BITS)
    for k in range(step, stop):
        width = min(lanes, n - k * lanes)
        x = state[:width]
        slot = x & mask
        s = table.symbol[slot]
        out[k * lanes - first : k * lanes - first + width] = s
        x = table.freq[s] * (x >> bits) + slot - table.base[s]
        low = np.flatnonzero(x < LOW)
        if len(low):
            x[low] = (x[low] << np.uint64(32)) | words[pos : pos + len(low)]
            pos += len(low)
        state[:width] = x
    if point is None and zlib.crc32(out.astype("<u4").tobytes()) != crc:
        raise ValueError("the block's ids don't match their checksum")
    return out


# --- tokenizing -------------------------------------------------------------


#: The parts of a tokenizer file for which word_pieces holds: lower case, white space to one space, and runs of
#: letters, single numbers, endings and runs of marks as pre-tokens.
NORMALIZER = ("NFC", ("Replace", "\\s+", " "), "Lowercase")
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits_by_words(path: str) -> bool:
    """Whether the file's normaliser, pre-tokenizer and special tokens are those that :func:`word_pieces` stands on."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    steps = (found.get("normalizer") or {}).get("normalizers", [])
    kinds = tuple((x["type"], x["pattern"].get("Regex"), x["content"]) if x["type"] == "Replace" else x["type"] for x in steps)
    cuts = (found.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = [x for x in cuts if x["type"] == "Split"]
    plain = [x for x in cuts if x["type"] == "ByteLevel" and not x["add_prefix_space"] and not x["use_regex"]]
    return (
        kinds == NORMALIZER and len(cuts) == 2 and len(split) == len(plain) == 1 and split[0]["pattern"] == {"Regex": SPLIT} and split[0]["invert"] and split[0]["behavior"] == "Removed"
        and all(x["content"].startswith("<|") for x in found["added_tokens"]) and not found.get("post_processor") and found["model"]["type"] == "BPE"
    )


def _tokenizer(path: str):
    if path not in _state:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _state[path] = Tokenizer.from_file(path), T.SpanCache(CACHE), splits_by_words(path)
    return _state[path]


def word_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans that the tokenizer treats independently of what stands beside them, and n + 1 row offsets into them.

    White space always ends a pre-token.  So do marks after a letter or a number: those at a word's end become a span of
    their own if an ASCII letter or digit, or a Latin-1 letter, stands before them.
    """
    starts, ends, at = T.words(data, offsets)
    if not len(starts):
        return starts, ends, at
    plain = np.concatenate(([0], np.cumsum(~_TRAIL[data])))
    # The last byte of each word that isn't such a mark.
    last = np.searchsorted(plain, plain[ends], "left") - 1
    before = data[np.maximum(last, 0)]
    lead = data[np.maximum(last - 1, 0)]
    latin = (lead == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)
    cut = (last >= starts) & (last < ends - 1) & (_ALNUM[before] | (latin & (last - 1 >= starts)))
    extra = np.flatnonzero(cut)
    middle = last[extra] + 1
    all_starts = np.insert(starts, extra + 1, middle)
    whole_ends = ends.copy()
    whole_ends[extra] = middle
    all_ends = np.insert(whole_ends, extra + 1, ends[extra])
    return all_starts, all_ends, np.searchsorted(all_starts, offsets)


def tokenize(path: str, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts by the tokenizer file, without added special tokens, and n + 1 row offsets.

    Each different piece is tokenized once; with a file of other rules than :func:`splits_by_words` knows, each different text.
    """
    tokenizer, cache, by_words = _tokenizer(path)
    if not by_words:
        starts, ends, at = offsets[:-1], offsets[1:], np.arange(len(offsets))
    elif b"<|" in data.tobytes():  # might be a special token's string: its letters' case and the marks in it matter
        starts, ends, at = T.words(data, offsets)
    else:
        data = _LOWER[data]
        starts, ends, at = word_pieces(data, offsets)

    def encode(a, b):
        raw = data.tobytes()
        found = [x.ids for x in tokenizer.encode_batch_fast([raw[i:j].decode("utf-8") for i, j in zip(a.tolist(), b.tolist())], add_special_tokens=False)]
        lens = np.fromiter(map(len, found), np.int64, len(found))
        return np.array([i for ids in found for i in ids], np.int32), np.concatenate(([0], np.cumsum(lens)))

    ids, span_at = cache.lookup(data, starts, ends, encode)
    return ids, span_at[at]


def vocabulary_size(path: str) -> int:
    return _tokenizer(path)[0].get_vocab_size(with_added_tokens=True)


# --- files ------------------------------------------------------------------


def write_tokens(docs: DataFrame, tokenizer_path: str, out: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> str:
    """Encode all rows in ascending id order into block files under ``out``.

    Text is range-partitioned by id once and tokenized once; ids are kept as 16 or 32 bits a token, from which the exact counts
    of all documents give the shared table, and then the blocks.  A null text is a document with the end id alone;
    null ids come first; rows with equal ids stand by their text's hash.  An empty table gives files without blocks.
    """
    spark = docs.sparkSession
    size = vocabulary_size(tokenizer_path)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def tokens(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in T.chunks(batch):
                ids, at = tokenize(tokenizer_path, *T.buffers(piece.column("text")))
                n = piece.num_rows
                ids = np.insert(ids, at[1:], end_id).astype(kind)
                at = at + np.arange(n + 1)
                wide = ids.dtype.itemsize
                blob = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((at * wide).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seq, seq + n)), piece.column("doc_id"), blob], ["part", "seq", "doc_id", "ids"])
                seq += n

    schema = "part int, seq long, doc_id long, ids binary"
    rows.mapInArrow(tokens, schema).write.option("compression", "zstd").parquet(f"{out}/tokens")
    kept = spark.read.schema(schema).parquet(f"{out}/tokens")

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column("ids").to_pylist()), kind)
            total += np.bincount(ids, minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    found = kept.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # at most a row per token
    counts = np.zeros(size, np.int64)
    counts[found["id"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    freq = scaled(counts)
    spark.createDataFrame(pd.DataFrame({"id": np.arange(size), "freq": freq})).coalesce(1).write.parquet(f"{out}/table")

    def blocks(batches):
        table = Table(freq)
        held: list = []
        held_ids = 0

        def flush():
            ids = np.frombuffer(b"".join(x[3] for x in held), kind).astype(np.int64)
            lens = [len(x[3]) // np.dtype(kind).itemsize for x in held]
            row = [[held[0][0]], [held[0][1]], [[x[2] for x in held]], [lens], [encode_block(table, ids)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()))], ["part", "seq", "doc_ids", "lens", "block"])

        for batch in batches:
            for x in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held and (held_ids >= BLOCK_IDS or x[0] != held[-1][0] or x[1] != held[-1][1] + 1):
                    yield flush()
                    held, held_ids = [], 0
                held.append(x)
                held_ids += len(x[3]) // np.dtype(kind).itemsize
        if held:
            yield flush()

    kept.mapInArrow(blocks, "part int, seq long, doc_ids array<long>, lens array<long>, block binary").write.option("compression", "none").parquet(f"{out}/blocks")
    return out


def read_tokens(spark, out: str) -> DataFrame:
    """Decode the files, each block by itself: ``part, seq, doc_id, ids`` (binary of little-endian unsigned 32-bit ids)."""
    freq = spark.read.parquet(f"{out}/table").orderBy("id").toPandas()["freq"].to_numpy(np.int64)  # a row per token

    def run(batches):
        table = Table(freq)
        for batch in batches:
            for i in range(batch.num_rows):
                part, seq, doc_ids, lens, block = (batch.column(c)[i].as_py() for c in range(5))
                ids = decode_block(table, block).astype("<u4")
                at = np.concatenate(([0], np.cumsum(lens)))
                n = len(lens)
                blob = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((at * 4).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seq, seq + n)), pa.array(doc_ids, pa.int64()), blob], ["part", "seq", "doc_id", "ids"])

    rows = spark.read.schema("part int, seq long, doc_ids array<long>, lens array<long>, block binary").parquet(f"{out}/blocks")
    return rows.mapInArrow(run, "part int, seq long, doc_id long, ids binary")


def token_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write the files in the shared folder, read them back: ``id_col, start, n_tokens, ids_crc32`` of each document.

    ``start`` is the number of ids before the document in file order; cases as in :func:`write_tokens`.
    """
    spark = docs.sparkSession
    out = write_tokens(docs, tokenizer_path, new_path(spark, "tokens"), id_col, text_col, end_id)
    # The ids are dropped where they were decoded: what goes on is four numbers a document.
    rows = read_tokens(spark, out).select("part", "seq", "doc_id", (F.length("ids") / 4).cast("long").alias("n"), F.crc32("ids").alias("crc"))
    path = new_path(spark, "digests")
    rows.write.parquet(path)
    rows = spark.read.schema("part int, seq long, doc_id long, n long, crc long").parquet(path)
    sums = rows.groupBy("part").agg(F.sum("n").alias("n")).toPandas().sort_values("part")  # a row per partition
    sums["base"] = sums["n"].cumsum() - sums["n"] if len(sums) else []
    bases = spark.createDataFrame(sums[["part", "base"]].astype("int64"), "p long, base long")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(bases), F.col("part") == F.col("p")).select(F.col("doc_id").alias(id_col), (F.col("base") + before).cast("long").alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
