"""Language identification: a linear-chain conditional random field over the words of a text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .sample import texts_of

#: The model learns from at most so many documents of a language.
TRAIN_PER_LANG = 60
#: Feature tables: hashed affixes, trigrams and words.
BITS = 16
SLOTS = 1 << BITS
KINDS = 8  # prefixes of 1 to 3 bytes, suffixes of 1 to 3 bytes, trigrams, lexicon
#: Words of a training sequence, and the chance that the next word goes on in another language's text.
SEQUENCE, SWITCH = 64, 0.03  # a sequence is no longer than a block
EPOCHS, RATE, DECAY = 12, 0.5, 1e-6
#: Words of a block in the forward-backward pass.
BLOCK = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[0x80:] = True


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row offsets of runs of letters (ASCII letters, and bytes beyond ASCII)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = _LETTER[data]
    filled = offsets[1:] > offsets[:-1]
    first = np.concatenate(([True], ~solid[:-1]))
    first[offsets[:-1][filled]] = True
    last = np.concatenate((~solid[1:], [True]))
    last[offsets[1:][filled] - 1] = True
    starts = np.flatnonzero(solid & first)
    return starts, np.flatnonzero(solid & last) + 1, np.searchsorted(starts, offsets)


def _slot(h: np.ndarray) -> np.ndarray:
    return (T.mixed(h) >> np.uint64(64 - BITS)).astype(np.int64)


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the affixes and of the word itself (n, 7), and the slot of the trigram that begins at each byte."""
    low = _LOWER[data].astype(np.uint64)
    pad = np.concatenate((low, np.zeros(3, np.uint64)))
    size = ends - starts
    cols = []
    for k in (1, 2, 3):
        h = np.zeros(len(starts), np.uint64)
        for j in range(k):
            h = h * np.uint64(256) + np.where(j < size, pad[starts + j], 0)
        cols.append(_slot(h * np.uint64(8) + np.uint64(k)))
    for k in (1, 2, 3):
        h = np.zeros(len(starts), np.uint64)
        for j in range(k):
            h = h * np.uint64(256) + np.where(j < size, pad[np.maximum(ends - 1 - j, 0)], 0)
        cols.append(_slot(h * np.uint64(8) + np.uint64(k + 3)))
    cols.append((T.span_hashes(_LOWER[data], starts, ends) >> np.uint64(64 - BITS)).astype(np.int64))
    n = len(data)
    gram = (pad[:n] * np.uint64(65536) + pad[1 : n + 1] * np.uint64(256) + pad[2 : n + 2]) * np.uint64(8) + np.uint64(7)
    return np.stack(cols, 1) if len(starts) else np.zeros((0, 7), np.int64), _slot(gram)


def emissions(model: dict, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unnormalised log scores (words, languages); each different word is scored once."""
    _, place, back = np.unique(T.span_hashes(_LOWER[data], starts, ends), return_index=True, return_inverse=True)
    starts, ends = starts[place], ends[place]
    affix, gram = word_features(data, starts, ends)
    w = model["w"]
    out = np.tile(model["bias"], (len(starts), 1))
    for j in range(7):
        out += w[j if j < 6 else 7][affix[:, j]]
    word, at = _grams(starts, ends)
    scores = w[6][gram[at]]
    for k in range(out.shape[1]):
        out[:, k] += np.bincount(word, scores[:, k], len(starts))
    return out[back]


def _grams(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word and the first byte of every trigram."""
    spans = np.maximum(ends - starts - 2, 0)
    word = np.repeat(np.arange(len(starts)), spans)
    return word, np.arange(len(word)) + (starts - np.cumsum(spans) + spans)[word]


def forward_backward(scores: np.ndarray, at: np.ndarray, trans: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """Marginals (words, languages) of the chain of each row.

    Chains are cut into blocks of BLOCK words.  All blocks' transfer matrices are made at once, one short loop per row of
    blocks passes messages between them, and all blocks then run the ordinary recursions at once, so a long
    text costs no more steps than its words.  ``pairs`` (languages, languages) gets the expected transitions added; then no
    chain may be longer than a block.
    """
    n, k = scores.shape
    if not n:
        return scores
    lens = np.diff(at)
    blocks = -(-lens // BLOCK)
    first = np.concatenate(([0], np.cumsum(blocks)))
    total, most = int(first[-1]), int(blocks.max())
    row = np.repeat(np.arange(len(lens)), lens)
    inside = np.arange(n) - at[row]
    block, t = first[row] + inside // BLOCK, inside % BLOCK
    # Blocks stand by falling length, so that the ones that reach a step are the first so many.
    held = np.bincount(block, minlength=total)
    rank = np.empty(total, np.int64)
    rank[np.argsort(-held, kind="stable")] = np.arange(total)
    reach = np.searchsorted(np.sort(-held), -np.arange(BLOCK), "left")
    b = rank[block]
    e = np.ones((BLOCK, total, k))
    e[t, b] = np.maximum(np.exp(scores - scores.max(1, keepdims=True)), 1e-30)
    step = np.exp(trans - trans.max())
    into, back = np.ones((total, k)) / k, np.ones((total, k))
    begins = np.zeros(total, bool)  # a chain's first block: its first word has no transition before it
    begins[rank[first[:-1][lens > 0]]] = True
    if most > 1:
        # Transfer of a block: row vector of the state before it -> row vector after it.
        move = np.tile(np.eye(k), (total, 1, 1))
        for i in range(BLOCK):
            c = reach[i]
            moved = (move[:c].reshape(-1, k) @ step).reshape(c, k, k)
            if i == 0:
                moved[begins[:c]] = 1.0
            move[:c] = moved * e[i, :c, None, :]
            if i % 8 == 7:
                move[:c] /= move[:c].sum((1, 2), keepdims=True)
        for i in range(1, most):
            on = first[:-1][blocks > i] + i
            m = np.einsum("bi,bij->bj", into[rank[on - 1]], move[rank[on - 1]])
            into[rank[on]] = m / m.sum(1, keepdims=True)
        for i in range(most - 1):
            on = first[1:][blocks > i + 1] - 2 - i
            m = np.einsum("bij,bj->bi", move[rank[on + 1]], back[rank[on + 1]])
            back[rank[on]] = m / m.sum(1, keepdims=True)
    alpha = np.empty((BLOCK, total, k))
    now = into
    for i in range(BLOCK):
        c = reach[i]
        nxt = now[:c] @ step
        if i == 0:
            nxt[begins[:c]] = 1.0
        nxt = np.maximum(nxt * e[i, :c], 1e-300)
        now[:c] = nxt / nxt.sum(1, keepdims=True)
        alpha[i, :c] = now[:c]
    now = back
    for i in range(BLOCK - 1, -1, -1):
        c = reach[i]
        if pairs is not None and i:
            both = alpha[i - 1, :c, :, None] * step * (e[i, :c] * now[:c])[:, None, :]
            pairs += (both / both.sum((1, 2), keepdims=True)).sum(0)
        alpha[i, :c] *= now[:c]
        nxt = (e[i, :c] * now[:c]) @ step.T
        now[:c] = nxt / nxt.sum(1, keepdims=True)
    out = alpha[t, b]
    return out / out.sum(1, keepdims=True)


def fit(texts: list[str], langs: list[str], seed: int = 7) -> dict:
    """Learn emission weights and transitions by gradient steps on code-switched sequences.

    Each training document has one language, so sequences are spliced: after each word, with chance SWITCH, the sequence
    goes on in a document of another language.  The gradient is that of the chain's log likelihood.
    """
    names = sorted(set(langs))
    k, rng = len(names), np.random.default_rng(seed)
    data, offsets = T.buffers(pa.array(texts, pa.string()))
    starts, ends, at = letter_runs(data, offsets)
    label = np.array([names.index(x) for x in langs])[T.row_of(at)] if len(starts) else np.zeros(0, np.int64)
    model = {"langs": names, "w": np.zeros((KINDS, SLOTS, k), np.float32), "bias": np.zeros(k), "trans": np.zeros((k, k))}
    if k < 2 or not len(starts):
        return model
    # The order of words: pieces of geometric length, shuffled, so that neighbours are often of different languages.
    cut = rng.random(len(starts)) < SWITCH
    cut[at[:-1][np.diff(at) > 0]] = True
    piece = np.cumsum(cut)
    order = np.argsort(rng.permutation(piece.max() + 1)[piece], kind="stable")
    affix, gram = word_features(data, starts, ends)
    gram_word, gram_at = _grams(starts, ends)
    gram_slot = gram[gram_at]
    truth = np.eye(k)[label]
    seq = np.append(np.arange(0, len(order), SEQUENCE), len(order))
    second = {kind: np.full((SLOTS, k), 1e-6) for kind in range(KINDS)}
    second_t = np.full((k, k), 1e-6)
    inner = np.arange(1, len(order)) % SEQUENCE > 0
    seen = np.bincount((label[order][:-1] * k + label[order][1:])[inner], minlength=k * k).reshape(k, k)
    model["trans"] = np.log((seen + 1.0) / (seen + 1.0).sum(1, keepdims=True))
    for _ in range(EPOCHS):
        score = emissions(model, data, starts, ends)
        p = np.empty_like(score)
        pairs = np.zeros((k, k))
        p[order] = forward_backward(score[order], seq, model["trans"], pairs)
        grad = (truth - p) / len(starts)
        for kind in range(KINDS):
            slot, word = (gram_slot, gram_word) if kind == 6 else (affix[:, kind if kind < 6 else 6], np.arange(len(starts)))
            g = np.stack([np.bincount(slot, grad[word, j], SLOTS) for j in range(k)], 1) - DECAY * model["w"][kind]
            second[kind] += g * g
            model["w"][kind] += (RATE * g / np.sqrt(second[kind])).astype(np.float32)
        g = (seen - pairs) / len(starts)
        second_t += g * g
        model["trans"] += 0.1 * RATE * g / np.sqrt(second_t)
    return model


def predict(model: dict, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """The language with the largest mean marginal over the words of each text, and that mean; ``und`` and 0 without a letter."""
    data, offsets = T.buffers(column)
    starts, ends, at = letter_runs(data, offsets)
    n, names = len(offsets) - 1, model["langs"]
    if not names:
        return ["und"] * n, np.zeros(n)
    p = forward_backward(emissions(model, data, starts, ends), at, model["trans"])
    row, size = T.row_of(at), (ends - starts).astype(float)
    mass = np.stack([np.bincount(row, p[:, j] * size, n) for j in range(len(names))], 1)
    mean = mass / np.maximum(mass.sum(1, keepdims=True), 1e-12)
    ascii_letters = np.bincount(np.searchsorted(offsets, np.flatnonzero(_LETTER[data] & (data < 0x80)), "right") - 1, minlength=n)
    texts = None
    out, score = [], np.zeros(n)
    for i in range(n):
        if not ascii_letters[i]:
            texts = texts or column.to_pylist()
            if not any(c.isalpha() for c in texts[i] or ""):
                out.append("und")
                continue
        best = int(np.argmax(mean[i]))
        out.append(names[best])
        score[i] = min(1.0, mean[i, best])
    return out, score


def train_on(docs: DataFrame, where, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = TRAIN_PER_LANG) -> dict:
    """A model fitted on at most ``per_lang`` documents of each language among the rows for which ``where`` holds.

    Every language is learned; the model takes 2 MB for each.
    """
    rows = docs.where(where & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    # A hash threshold lets about 2 * per_lang documents of each language through; a row for each language is broadcast.
    shares = docs.sparkSession.createDataFrame([(r["lang"], int(min(1.0, 2.0 * per_lang / r["n"]) * 2**31)) for r in counts], "__lang string, __share long")
    picked = rows.join(F.broadcast(shares), F.col("lang") == F.col("__lang")).where(F.pmod(F.xxhash64("id"), F.lit(2**31)) < F.col("__share"))
    found = picked.select("id", "lang").orderBy(F.xxhash64("id")).limit(4 * per_lang * max(64, len(counts))).collect()
    chosen: dict[str, list[int]] = {}
    for r in found:
        if len(mine := chosen.setdefault(r["lang"], [])) < per_lang:
            mine.append(r["id"])
    lang_of = {i: lang for lang, ids in chosen.items() for i in ids}
    table = texts_of(docs, list(lang_of), id_col, text_col)
    return fit(table["text"].to_pylist(), [lang_of[i] for i in table["doc_id"].to_pylist()])


def language_id(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Label every row: ``id_col, lang_pred, score``.

    Null texts and texts without a letter get ``und`` and 0.  Every row is predicted from its whole text alone; repeated
    rows get equal results, ties go to the first language by code point, an empty table gives an empty result
    and extra columns are ignored.
    """

    def run(batches):
        for batch in batches:
            for part in T.chunks(batch):
                lang, score = predict(model, part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double").withColumnRenamed("doc_id", id_col)
