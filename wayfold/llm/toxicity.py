"""Toxicity: a chain of linear classifiers, each fed the probabilities of the categories before it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .langid import letter_runs
from .sample import labelled, remainder

#: The chain is fitted on at most so many labelled documents.
TRAIN_ROWS = 6_000
#: Categories in the order of the chain.  ``severe``: documents marked toxic with at least SEVERE_HITS of the SEVERE_TERMS most
#: telling terms; ``toxic``: the label itself.
CATEGORIES = ("severe", "toxic")
SEVERE_TERMS, SEVERE_HITS = 200, 4
#: Terms: letter runs, and their beginnings of so many bytes.
PREFIXES = (5, 6, 7, 9)
#: A term takes part if it stands in so many toxic training documents; the most telling MAX_TERMS of them are features.
MIN_DOCS, MAX_TERMS = 4, 4_000
FOLDS, STEPS, L2 = 5, 300, 1e-3
#: Training texts are counted in groups of about so many characters.
PIECE = 500_000
#: A document is rejected from this probability of the last category on.
THRESHOLD = 0.5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def terms(data: np.ndarray, offsets: np.ndarray, unique_first: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every term of every text, each different word of a row once."""
    starts, ends, at = letter_runs(data, offsets)
    low, row = _LOWER[data], T.row_of(at)
    word = T.span_hashes(low, starts, ends)
    if unique_first and len(word):
        order = np.lexsort((word, row))
        new = np.concatenate(([True], (word[order][1:] != word[order][:-1]) | (row[order][1:] != row[order][:-1])))
        pick = order[new]
        starts, ends, row, word = starts[pick], ends[pick], row[pick], word[pick]
    rows, hashes = [row], [word]
    for n in PREFIXES:
        long = ends - starts > n
        rows.append(row[long])
        hashes.append(T.mixed(T.span_hashes(low, starts[long], starts[long] + n) + np.uint64(n)))
    return np.concatenate(rows), np.concatenate(hashes)


def features(keys: np.ndarray, sieve: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of every (document, selected term) pair, each once.  ``sieve`` has a bit for the low 16 bits of each key."""
    row, h = terms(data, offsets)
    maybe = sieve[(h & np.uint64(0xFFFF)).astype(np.int64)]
    row, h = row[maybe], h[maybe]
    if not len(keys) or not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    hit = keys[place] == h
    pair = np.unique(row[hit] * len(keys) + place[hit])
    return pair // len(keys), pair % len(keys)


def _logistic(rows, cols, n, width, extra, truth) -> np.ndarray:
    """Weights of a ridge logistic regression on 0/1 features, extra columns and a constant; plain gradient steps with momentum."""
    w = np.zeros(width + extra.shape[1] + 1)
    if not n:
        return w
    v = np.zeros_like(w)
    count = np.concatenate((np.bincount(cols, minlength=width), (extra**2).sum(0), [n])) + 1.0
    rate = 1.0 / np.sqrt(count / n + 1e-3) / n
    for _ in range(STEPS):
        z = np.bincount(rows, w[cols], n) + extra @ w[width:-1] + w[-1]
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - truth
        grad = np.concatenate((np.bincount(cols, g[rows], width), extra.T @ g, [g.sum()]))
        grad[:-1] += L2 * n * w[:-1] * 0.01
        v = 0.9 * v - rate * grad
        w = w + v
    return w


def _probability(w, rows, cols, n, extra) -> np.ndarray:
    width = len(w) - extra.shape[1] - 1
    z = np.bincount(rows, w[:width][cols], n) + extra @ w[width:-1] + w[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _telling(keys: np.ndarray, bad: np.ndarray, good: np.ndarray, n_bad: float, n_good: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the terms that take part, by key, and of the most telling of them, by log odds."""
    odds = np.log((bad + 0.5) / (n_bad + 1)) - np.log((good + 0.5) / (n_good + 1))
    some = np.flatnonzero((bad >= MIN_DOCS) & (odds > 1.0))
    best = some[np.lexsort((keys[some], -odds[some] * np.sqrt(bad[some])))][:MAX_TERMS]
    return np.sort(best), best[:SEVERE_TERMS]


def fit(texts: list[str], toxic: np.ndarray) -> dict:
    """Select terms by log odds, derive the categories, and fit the chain on out-of-fold probabilities.

    For each fold, terms, categories and models are chosen from the other folds alone; the probabilities that they give to
    the fold's documents are what the next category's model is fed in training.
    """
    toxic = np.asarray(toxic, float)
    n = len(texts)
    fold = (T.mixed(np.arange(n, dtype=np.uint64)) % np.uint64(FOLDS)).astype(np.int64)
    keys, counts = np.zeros(0, np.uint64), np.zeros((0, FOLDS, 2))
    for first, column in T.pieces(texts, PIECE):  # counts of one group of texts at a time: documents by term, fold and label
        row, h = terms(*T.buffers(column))
        _, one = np.unique(T.mixed(h + T.mixed(row.astype(np.uint64))), return_index=True)
        some, where = np.unique(h[one], return_inverse=True)
        doc = first + row[one]
        now = np.bincount((where * FOLDS + fold[doc]) * 2 + toxic[doc].astype(np.int64), minlength=len(some) * FOLDS * 2).reshape(-1, FOLDS, 2)
        both, back = np.unique(np.concatenate((keys, some)), return_inverse=True)
        merged = np.zeros((len(both), FOLDS, 2), np.int32)
        np.add.at(merged, back[: len(keys)], counts.astype(np.int32))
        np.add.at(merged, back[len(keys) :], now.astype(np.int32))
        keys, counts = both, merged
    docs = np.stack([np.bincount(fold, 1 - toxic, FOLDS), np.bincount(fold, toxic, FOLDS)], 1) if n else np.zeros((FOLDS, 2))
    chosen = []  # for each fold, then for all documents: the terms, the strongest of them
    for k in [*range(FOLDS), None]:
        seen = np.arange(FOLDS) != (-1 if k is None else k)
        sums, of = counts[:, seen].sum(1), docs[seen].sum(0)
        chosen.append(_telling(keys, sums[:, 1], sums[:, 0], of[1], of[0]))
    used = np.unique(np.concatenate([x for x, _ in chosen])) if len(keys) else np.zeros(0, np.int64)
    wide = keys[used]
    found = [(first, *features(wide, _sieve(wide), *T.buffers(column))) for first, column in T.pieces(texts, PIECE)]
    rows = np.concatenate([first + r for first, r, _ in found]) if found else np.zeros(0, np.int64)
    cols = np.concatenate([c for *_, c in found]) if found else np.zeros(0, np.int64)
    views = []  # the same for each fold: its pairs of document and own column, the width, whether a document is severe
    for best, strong in chosen:
        at = np.full(len(used), -1, np.int64)
        at[np.searchsorted(used, best)] = np.arange(len(best))
        hard = np.zeros(len(used))
        hard[np.searchsorted(used, strong)] = 1.0
        on = at[cols] >= 0 if len(cols) else np.zeros(0, bool)
        severe = toxic * (np.bincount(rows, hard[cols] if len(cols) else None, n) >= SEVERE_HITS)
        views.append((rows[on], at[cols[on]], len(best), {"severe": severe, "toxic": toxic}))
    model = {"keys": wide[np.searchsorted(used, chosen[-1][0])], "categories": CATEGORIES, "chain": []}
    model["sieve"] = _sieve(model["keys"])
    extra = np.zeros((n, 0))
    for name in CATEGORIES:
        out = np.zeros(n)
        for k in range(FOLDS):
            r, c, width, truth = views[k]
            seen = fold != k
            keep, again = seen[r], np.cumsum(seen) - 1
            w = _logistic(again[r[keep]], c[keep], int(seen.sum()), width, extra[seen], truth[name][seen])
            out[~seen] = _probability(w, r, c, n, extra)[~seen]
        r, c, width, truth = views[-1]
        model["chain"].append(_logistic(r, c, n, width, extra, truth[name]))
        extra = np.column_stack((extra, out))
    return model


def _sieve(keys: np.ndarray) -> np.ndarray:
    out = np.zeros(65536, bool)
    out[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True
    return out


def predict(model: dict, column: pa.Array) -> np.ndarray:
    """Probabilities (texts, categories); each category's model gets those of the categories before it."""
    data, offsets = T.buffers(column)
    n = len(offsets) - 1
    rows, cols = features(model["keys"], model["sieve"], data, offsets)
    extra = np.zeros((n, 0))
    for w in model["chain"]:
        extra = np.column_stack((extra, _probability(w, rows, cols, n, extra)))
    return extra


def train_on(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> dict:
    """A chain fitted on at most ``limit`` labelled documents; those of remainder 0 modulo 5 are held out."""
    table, known = labelled(docs, labels, ["toxic"], remainder("doc_id", 5) != 0, limit)
    ids = table["doc_id"].to_pylist()
    model = fit(table["text"].to_pylist(), np.array([known[i][0] for i in ids]))
    del table
    T.trim()
    return model


def score_toxicity(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """Score every row's whole text: ``id_col, p_severe, p_toxic, toxic``, and the columns named by ``keep``.

    Null and empty texts have no terms and get the chain's base rates.  Repeated rows get equal scores; a null id stays null;
    an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    names = [f"p_{c}" for c in CATEGORIES]

    def run(batches):
        for batch in batches:
            for part in T.chunks(batch, "__text"):
                p = predict(model, part.column("__text"))
                rest = [part.column(i) for i in range(1, part.num_columns)]
                yield pa.RecordBatch.from_arrays([*rest, *(pa.array(p[:, j]) for j in range(p.shape[1])), pa.array(p[:, -1] >= threshold)], names=out.names)

    kept = [F.col(c).alias(f"__{i}") for i, c in enumerate((id_col, *keep))]
    rows = docs.select(F.col(text_col).cast("string").alias("__text"), *kept)
    from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

    out = StructType([*rows.schema.fields[1:], *(StructField(f"__p{j}", DoubleType()) for j in range(len(names))), StructField("__toxic", BooleanType())])
    return rows.mapInArrow(T.tidied(run), out).toDF(id_col, *keep, *names, "toxic")
