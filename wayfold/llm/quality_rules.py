"""Quality rules: Jensen-Shannon distance of a text's histograms to language references."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .store import written

#: The symbols that are counted.
SYMBOLS = b"#*$%&|<>"
#: Punctuation of prose; other ASCII marks are symbols.
PUNCTUATION = b".,;:'\"?!()-"
#: Character classes: lower, upper, digit, beyond ASCII, prose punctuation, other marks.
CLASSES = 6
#: A common word of a language makes up at least this part of its words; so many of them at most are bins.
COMMON_SHARE, COMMON_WORDS = 1 / 2000, 64
#: Least words and characters for a verdict, and the distances beyond which a text is rejected.
MIN_WORDS, MIN_CHARS = 60, 300
CLASS_LIMIT, WORD_LIMIT = 0.30, 0.48
#: Counts that one task holds of a language before small ones are dropped (see _held_counts).
HELD = 1_000_000
#: Tasks that add up the partitions' counts before the driver does.
SUM_TASKS = 16

_CLASS = np.full(256, -1, np.int8)
_CLASS[33:127] = 5
_CLASS[list(PUNCTUATION)] = 4
_CLASS[48:58] = 2
_CLASS[65:91] = 1
_CLASS[97:123] = 0
_CLASS[0xC2:] = 3
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (row, hash), and for each place in it whether it equals the place before, and the one after."""
    order = np.lexsort((hashes, rows))
    if not len(order):
        return order, np.zeros(0, bool), np.zeros(0, bool)
    same = (rows[order][1:] == rows[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
    return order, np.concatenate(([False], same)), np.concatenate((same, [False]))


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each text: words, code points in words, symbols, lines equal to an earlier one, words in repeated 5-word windows."""
    starts, ends, at = T.words(data, offsets)
    n, n_words = len(offsets) - 1, np.diff(at)
    out = {"n_words": n_words, "word_chars": _sums(((data & 0xC0) != 0x80) & ~T.IS_SPACE[data], offsets), "n_symbols": _sums(_SYMBOL[data], offsets)}
    filled = offsets[1:] > offsets[:-1]
    begins = np.union1d(offsets[:-1][filled], np.flatnonzero(data == 10) + 1)
    begins = begins[begins < len(data)]
    stops = np.concatenate((begins[1:], [len(data)])) if len(begins) else begins
    if len(begins):
        stops = stops - (data[stops - 1] == 10)
    some = np.searchsorted(starts, begins) < np.searchsorted(starts, stops)
    begins, stops = begins[some], stops[some]
    line_row = np.searchsorted(offsets, begins, "right") - 1
    order, before, _ = _repeats(line_row, T.span_hashes(data, begins, stops))
    out["n_dup_lines"] = np.bincount(line_row[order][before], minlength=n)
    word = T.span_hashes(data, starts, ends)
    out["n_repeat_words"] = np.zeros(n, np.int64)
    row = T.row_of(at)
    if len(word) >= 5:
        m = len(word) - 4
        whole = row[:m] == row[4:]
        h = np.zeros(m, np.uint64)
        for k in range(5):
            h = (h + word[k : k + m]) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
        place = np.flatnonzero(whole)
        order, before, after = _repeats(row[place], T.mixed(h[place]))
        hit = place[order[before | after]]
        cover = np.zeros(len(word) + 1, np.int64)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + 5, -1)
        out["n_repeat_words"] = _sums(np.cumsum(cover[:-1]) > 0, at)
    return out


def _class_counts(data, offsets) -> np.ndarray:
    kind, row = _CLASS[data], T.row_of(offsets)
    seen = kind >= 0
    return np.bincount(row[seen] * CLASSES + kind[seen], minlength=(len(offsets) - 1) * CLASSES).reshape(-1, CLASSES)


def _word_hashes(data, offsets):
    starts, ends, at = T.words(data, offsets)
    return T.span_hashes(_LOWER[data], starts, ends), at


def _held_counts(batches):
    """Lossy counts of a task's words per language: ``lang, word, n``; the row of a null word has all words, and in ``error`` what any count may lack."""
    held: dict = {}
    for batch in batches:
        for part in T.chunks(batch):
            data, offsets = T.buffers(part.column("text"))
            h, at = _word_hashes(data, offsets)
            row, langs = T.row_of(at), np.array([x or "" for x in part.column("lang").to_pylist()], object)
            kinds, code = np.unique(langs.astype(str), return_inverse=True)
            for k, lang in enumerate(kinds):
                keys, counts = np.unique(h[code[row] == k], return_counts=True)
                old = held.get(lang, (np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, 0))
                both, where = np.unique(np.concatenate((old[0], keys)), return_inverse=True)
                sums = np.bincount(where, np.concatenate((old[1], counts)), len(both)).astype(np.int64)
                error, total = old[2], old[3] + int(counts.sum())
                while len(both) > HELD:
                    least = int(np.median(sums))
                    error += least
                    stay = sums > least
                    both, sums = both[stay], sums[stay]
                held[lang] = (both, sums, error, total)
    for lang, (keys, counts, error, total) in held.items():
        n = len(keys)
        word = pa.array(np.append(keys.view(np.int64), 0), mask=np.arange(n + 1) == n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * (n + 1), pa.string()), word, pa.array(np.append(counts, total)), pa.array(np.append(np.zeros(n, np.int64), error))], ["lang", "word", "n", "error"])


def _candidates(rows: DataFrame) -> np.ndarray:
    """Hashes of the words that may reach COMMON_SHARE of a language: the tasks' counts are added up on the executors.

    What a task has dropped of a word is at most its error, so the sum of all errors is counted in the words' favour.  The driver gets at most
    1 / COMMON_SHARE words of a language, or those within the errors of it.
    """
    counts = rows.mapInArrow(_held_counts, "lang string, word long, n long, error long").groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum("error").alias("error"))
    counts = written(counts, "word-counts")
    whole = counts.where("word is null").select("lang", F.col("n").alias("total"), F.col("error").alias("slack"))  # a row for each language
    near = counts.where("word is not null").join(F.broadcast(whole), "lang").where(F.col("n") + F.col("slack") >= COMMON_SHARE * F.col("total"))
    return np.sort(near.select("word").distinct().toPandas()["word"].to_numpy().astype(np.int64).view(np.uint64))


def _exact(keys: np.ndarray):
    """Exact counts, per language, of the given words, then of all words, then of the classes: one row per language and task."""

    def run(batches):
        total: dict = {}
        for batch in batches:
            for part in T.chunks(batch):
                data, offsets = T.buffers(part.column("text"))
                h, at = _word_hashes(data, offsets)
                row, langs = T.row_of(at), np.array([x or "" for x in part.column("lang").to_pylist()], object).astype(str)
                kinds, code = np.unique(langs, return_inverse=True)
                place = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
                known = keys[place] == h if len(keys) else np.zeros(len(h), bool)
                classes = _class_counts(data, offsets)
                for k, lang in enumerate(kinds):
                    mine = code[row] == k
                    now = np.concatenate((np.bincount(place[mine & known], minlength=len(keys)), [mine.sum()], classes[code == k].sum(0)))
                    total[lang] = total.get(lang, 0) + now
        for lang, sums in total.items():
            yield _counts_row(lang, sums)

    return run


def _counts_row(lang: str, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([np.asarray(sums, np.int64)], pa.list_(pa.int64()))], ["lang", "counts"])


def _sum_counts(batches):
    """Sums of the rows of a task, one row per language at a time in memory."""
    total: dict = {}
    for batch in batches:
        for lang, counts in zip(batch.column("lang").to_pylist(), batch.column("counts")):
            total[lang] = total.get(lang, 0) + counts.values.to_numpy()
    for lang, sums in total.items():
        yield _counts_row(lang, sums)


def language_references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict:
    """Histograms of each language over all rows: exact counts of its common words and of the character classes.

    The candidates hold every word of a share of COMMON_SHARE or more; a second pass counts them exactly.  The number
    of languages is taken as bounded: the driver and each task hold the candidates' counts of every one.
    """
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    keys = _candidates(rows)
    each = rows.mapInArrow(_exact(keys), "lang string, counts array<long>")
    summed = each.repartition(SUM_TASKS).mapInArrow(_sum_counts, "lang string, counts array<long>").toPandas()  # SUM_TASKS rows per language
    table: dict[str, np.ndarray] = {}
    for lang, counts in zip(summed["lang"], summed["counts"]):
        table[lang] = table.get(lang, 0) + np.asarray(counts, np.float64)
    table = {lang: sums for lang, sums in table.items() if lang and sums[len(keys)] and sums[len(keys) + 1 :].sum()}
    langs = sorted(table)
    chosen: set[int] = set()
    for lang in langs:
        share = table[lang][: len(keys)] / table[lang][len(keys)]
        best = np.lexsort((keys, -share))[:COMMON_WORDS]
        chosen |= {int(i) for i in best if share[i] >= COMMON_SHARE}
    bins = np.array(sorted(chosen), np.int64)
    words, classes = [], []
    for lang in langs:
        own = table[lang][bins] if len(bins) else np.zeros(0)
        words.append(np.concatenate((own, [table[lang][len(keys)] - own.sum()])) / table[lang][len(keys)])
        kinds = table[lang][len(keys) + 1 :]
        classes.append(kinds / kinds.sum())
    return {"langs": langs, "keys": keys[bins] if len(bins) else keys[:0], "words": np.array(words).reshape(len(langs), len(bins) + 1), "classes": np.array(classes).reshape(len(langs), CLASSES)}


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Square root of the Jensen-Shannon divergence in bits, row by row: 0 for equal histograms, 1 for disjoint ones."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(-1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def _judge(refs: dict):
    langs = {x: i for i, x in enumerate(refs["langs"])}

    def run(batches):
        for batch in batches:
            for part in T.chunks(batch):
                data, offsets = T.buffers(part.column("text"))
                out = base_counts(data, offsets)
                n, n_words = part.num_rows, out["n_words"]
                h, at = _word_hashes(data, offsets)
                keys, row = refs["keys"], T.row_of(at)
                place = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
                bin_ = np.where(keys[place] == h, place, len(keys)) if len(keys) else np.zeros(len(h), np.int64)
                words = np.bincount(row * (len(keys) + 1) + bin_, minlength=n * (len(keys) + 1)).reshape(n, -1)
                words = words / np.maximum(words.sum(1, keepdims=True), 1)
                kinds = _class_counts(data, offsets)
                chars = kinds.sum(1)
                kinds = kinds / np.maximum(chars[:, None], 1)
                by_word, by_class = np.zeros(n), np.zeros(n)
                if langs:
                    each_w = np.stack([js_distance(words, q) for q in refs["words"]], 1)
                    each_c = np.stack([js_distance(kinds, q) for q in refs["classes"]], 1)
                    known = np.array([langs.get(x or "", -1) for x in part.column("lang").to_pylist()])
                    near = np.where(known >= 0, known, np.argmin(each_w + each_c, 1))
                    by_word, by_class = each_w[np.arange(n), near], each_c[np.arange(n), near]
                odd = ((n_words >= MIN_WORDS) & (by_word > WORD_LIMIT)) | ((chars >= MIN_CHARS) & (by_class > CLASS_LIMIT))
                failed = (n_words < 10) | (100 * out["n_repeat_words"] > 20 * n_words)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(out[k], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array(failed), pa.array(~failed & ~odd), pa.array(by_class), pa.array(by_word)],
                    ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"],
                )

    return run


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", references: dict | None = None) -> DataFrame:
    """Keep rows whose histograms lie near those of their language.

    A row fails the base rule with under 10 words or with over 20 % of its words in repeated 5-word windows.  Otherwise the
    method rejects it if the Jensen-Shannon distance to its language's reference is above CLASS_LIMIT for character
    classes (from MIN_CHARS classed characters on) or above WORD_LIMIT for common words (from MIN_WORDS words on).
    Shorter texts get no verdict against them.  Rows of null or unknown language are held against the nearest reference.

    Null and empty texts count 0 words and fail the base rule.  Repeated rows are judged each for itself, also in the
    references, which count all rows.  An empty table gives an empty result; extra columns are ignored.
    """
    refs = references or language_references(docs, text_col, lang_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"
    return rows.mapInArrow(_judge(refs), schema).withColumnRenamed("doc_id", id_col)
