"""Quality classifier: random-indexing word vectors, pooled, then a small network with calibrated probabilities."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .sample import labelled, remainder

#: The model is fitted on at most so many labelled documents.
TRAIN_ROWS = 4_000
#: Dimensions of a word vector, non-zero places of an index vector, words on each side that make a context.
DIM, PLACES, WINDOW = 32, 4, 2
#: Words with a context vector: the most frequent of the training texts.
VOCABULARY = 8_192
HIDDEN, STEPS, RATE, L2 = 32, 400, 0.01, 1e-4
#: A score from here on predicts label 1.
THRESHOLD = 0.3

#: Kinds of bytes: 0 space, 1 letter or digit or beyond ASCII, 2 mark.
_KIND = np.full(256, 1, np.int8)
_KIND[33:127] = 2
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = 1
_KIND[list(T.SPACES)] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of letters and of marks, and row offsets into them; a run of capitals alone is its own word."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    kind = _KIND[data]
    cut = np.concatenate(([True], kind[1:] != kind[:-1]))
    cut[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    starts = np.flatnonzero(cut)
    ends = np.concatenate((starts[1:], [len(data)]))
    solid = kind[starts] > 0
    starts, ends = starts[solid], ends[solid]
    up = np.concatenate(([0], np.cumsum(_UPPER[data])))
    shout = (ends - starts >= 3) & (up[ends] - up[starts] == ends - starts)
    h = T.span_hashes(_LOWER[data], starts, ends)
    return np.where(shout, np.uint64(0x5348_4F55_5400 + 1), h), np.searchsorted(starts, offsets)


def index_vectors(h: np.ndarray) -> np.ndarray:
    """Sparse random vectors, fixed by the word's hash: PLACES places of +1 or -1."""
    out = np.zeros((len(h), DIM), np.float32)
    at = np.arange(len(h))
    for k in range(PLACES):
        r = T.mixed(h + np.uint64(0x9E37 * (k + 1)))
        out[at, (r % np.uint64(DIM)).astype(np.int64)] += np.where((r >> np.uint64(40)) & np.uint64(1), 1.0, -1.0).astype(np.float32)
    return out


def learn_contexts(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and vectors of the most frequent words: normalised sums of the index vectors around them, plus their own."""
    keys, back, counts = np.unique(h, return_inverse=True, return_counts=True)
    row = T.row_of(at)
    top = np.sort(np.lexsort((keys, -counts))[:VOCABULARY])
    place = np.full(len(keys), -1, np.int32)
    place[top] = np.arange(len(top))
    index = index_vectors(keys)
    near = np.zeros((len(top), DIM))
    for gap in range(1, WINDOW + 1):
        same = row[gap:] == row[:-gap]
        for a, b in ((back[gap:], back[:-gap]), (back[:-gap], back[gap:])):
            known = same & (place[a] >= 0)
            word, beside = place[a[known]], b[known]
            for j in range(DIM):
                near[:, j] += np.bincount(word, index[beside, j], len(top))
    own = near / np.maximum(np.linalg.norm(near, axis=1, keepdims=True), 1e-6) + index[top] / np.sqrt(PLACES)
    return keys[top], own.astype(np.float32)


def pooled(model: dict, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text: the mean word vector, its length, the log of the number of words, and the share of different words."""
    h, at = tokens(data, offsets)
    n = len(offsets) - 1
    row = T.row_of(at)
    order = np.lexsort((h, row))
    new = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1]))) if len(h) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    word, owner = h[order][first], row[order][first]
    times = np.diff(np.concatenate((first, [len(h)]))).astype(np.float32)
    vectors = index_vectors(word) / np.float32(np.sqrt(PLACES))
    if len(model["keys"]) and len(word):
        place = np.minimum(np.searchsorted(model["keys"], word), len(model["keys"]) - 1)
        known = model["keys"][place] == word
        vectors[known] = model["vectors"][place[known]]
    total = np.maximum(np.diff(at), 1)
    mean = np.stack([np.bincount(owner, vectors[:, j] * times, n) for j in range(DIM)], 1) / total[:, None] if n else np.zeros((0, DIM))
    peak = np.zeros(n)
    np.maximum.at(peak, owner, times / total[owner])
    return np.column_stack((mean, np.linalg.norm(mean, axis=1), np.log1p(np.diff(at)), np.bincount(owner, minlength=n) / total, peak))


def _network(x, net):
    hidden = np.maximum(x @ net["w1"] + net["b1"], 0)
    return hidden, hidden @ net["w2"] + net["b2"]


def fit(texts: list[str], truth: np.ndarray, seed: int = 11) -> dict:
    """Word vectors, the network (Adam on four fifths of the rows) and its temperature (on the last fifth)."""
    truth = np.asarray(truth, float)
    parts = [tokens(*T.buffers(column)) for _, column in T.pieces(texts)]
    h = np.concatenate([x for x, _ in parts]) if parts else np.zeros(0, np.uint64)
    at = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(x) for _, x in parts])))) if parts else np.zeros(1, np.int64)
    model: dict = {"keys": np.zeros(0, np.uint64), "vectors": np.zeros((0, DIM), np.float32), "temperature": 1.0}
    if len(h):
        model["keys"], model["vectors"] = learn_contexts(h, at)
    del parts, h
    x = np.concatenate([pooled(model, *T.buffers(column)) for _, column in T.pieces(texts)]) if texts else np.zeros((0, DIM + 4))
    model["mean"], model["scale"] = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(DIM + 4), np.ones(DIM + 4))
    rng = np.random.default_rng(seed)
    net = {"w1": rng.normal(0, 0.3, (DIM + 4, HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, 0.3, HIDDEN), "b2": np.zeros(())}
    model["net"] = net
    if not len(x):
        return model
    x = (x - model["mean"]) / model["scale"]
    calibrate = T.mixed(np.arange(len(x), dtype=np.uint64)) % np.uint64(5) == 0
    if not 0 < truth[~calibrate].mean() < 1:
        net["w2"][:] = 0
        net["b2"] = np.array(np.log((truth.sum() + 0.5) / (len(truth) - truth.sum() + 0.5)))
        return model
    m = {k: np.zeros_like(v) for k, v in net.items()}
    v = {k: np.zeros_like(w) for k, w in net.items()}
    tx, ty = x[~calibrate], truth[~calibrate]
    for step in range(1, STEPS + 1):
        hidden, z = _network(tx, net)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - ty) / len(tx)
        gh = g[:, None] * net["w2"] * (hidden > 0)
        grads = {"w1": tx.T @ gh + L2 * net["w1"], "b1": gh.sum(0), "w2": hidden.T @ g + L2 * net["w2"], "b2": g.sum()}
        for k in net:
            m[k] = 0.9 * m[k] + 0.1 * grads[k]
            v[k] = 0.999 * v[k] + 0.001 * grads[k] ** 2
            net[k] = net[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    _, z = _network(x[calibrate], net)
    loss = lambda t: np.logaddexp(0, np.where(truth[calibrate] > 0, -z, z) / t).mean()
    model["temperature"] = float(min(np.geomspace(0.25, 8, 61), key=loss)) if calibrate.any() else 1.0
    return model


def predict(model: dict, column: pa.Array) -> np.ndarray:
    data, offsets = T.buffers(column)
    x = (pooled(model, data, offsets) - model["mean"]) / model["scale"]
    _, z = _network(x, model["net"])
    return 1 / (1 + np.exp(-np.clip(z / model["temperature"], -30, 30)))


def train_on(docs: DataFrame, labels: DataFrame, where=None, limit: int = TRAIN_ROWS) -> dict:
    """A model fitted on at most ``limit`` labelled documents for which ``where`` holds (default: crc32 remainder modulo 5 not 0)."""
    table, known = labelled(docs, labels, ["quality"], remainder("doc_id", 5) != 0 if where is None else where, limit)
    return fit(table["text"].to_pylist(), np.array([known[i][0] for i in table["doc_id"].to_pylist()]))


def score_quality(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Score every row's whole text: ``id_col, score, predicted``.

    Null and empty texts get the score of a text without words.  Repeated rows get equal scores; a score equal to the
    threshold predicts 1; an empty table gives an empty result; extra columns are ignored.
    """

    def run(batches):
        for batch in batches:
            for part in T.chunks(batch):
                score = predict(model, part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int").withColumnRenamed("doc_id", id_col)
