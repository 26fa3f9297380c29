"""N-gram Jaccard join: signature trees over word shingles, dual traversal, and classes of linked texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from .store import dropped, in_written_order, release, written

#: Words of a shingle, and the least similarity in percent.
SHINGLE, PERCENT = 5, 80
#: Bits of the token bitmaps in the trees; sets of over NARROW shingles have at least twice as many bits as shingles, up to
#: WIDEST, and are held against each other by these after the trees.
BITMAP, NARROW, WIDEST = 1024, 384, 1 << 14
#: The order of shingles puts those last that stand in at least HEAVY_DOCS of a sample of SAMPLE_DOCS documents.
#: Any order finds every link; this one keeps passages that many documents share out of the prefixes.
SAMPLE_DOCS, HEAVY_DOCS = 10_000, 3
#: Rows of a leaf, and children of a node above.
LEAF, FAN = 16, 4
#: Rows of a block: a posting list of more has several trees.
BLOCK = 2_048
#: Lists of at most so many rows are held against each other by sizes and places when they are made.
SHORT = 64
#: Rows of the lists that go through the trees together, pairs whose bitmaps are tested at once, and node pairs that are opened at once.
BUNDLE, STEP, PAIRS = 4_096, 16_384, 2_048
#: The first trees stand on the lists of so many first prefix shingles of each set.
FIRST = 2
#: Rounds on one row of each class, at most; they only save work of the exact round after them.
ROUNDS = 3

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MIX = [np.uint64(0x9E3779B97F4A7C15 + 2 * 0x51_7C_C1 * k) for k in range(64)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of all texts one after another, and n + 1 offsets.

    A text with fewer words than a shingle has its whole word sequence as its only one; one without words has none.
    """
    starts, ends, at = T.words(data, offsets)
    h = T.span_hashes(_LOWER[data], starts, ends)
    row, n = T.row_of(at), len(offsets) - 1
    rows, values = [], []
    if len(h) >= words:
        m = len(h) - words + 1
        acc = np.zeros(m, np.uint64)
        for k in range(words):
            acc = (acc + h[k : k + m]) * _MIX[k]
        inside = row[:m] == row[words - 1 :]
        rows.append(row[:m][inside])
        values.append(T.mixed(acc[inside]))
    lens = np.diff(at)
    for i in np.flatnonzero((lens > 0) & (lens < words)):
        acc = np.uint64(lens[i])
        with np.errstate(over="ignore"):
            for x in h[at[i] : at[i + 1]]:
                acc = (acc + x) * _MIX[words]
        rows.append(np.array([i]))
        values.append(T.mixed(np.array([acc], np.uint64)))
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    row, value = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.concatenate(([True], (value[1:] != value[:-1]) | (row[1:] != row[:-1]))) if len(row) else np.zeros(0, bool)
    return value[new], np.concatenate(([0], np.cumsum(np.bincount(row[new], minlength=n))))


def set_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums modulo 2^64 of each text's values."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:], dtype=np.uint64)
    return total[at[1:]] - total[at[:-1]]


def prefix_size(n: np.ndarray | int, percent: int = PERCENT):
    """So many first shingles in any common order hold one of every similar set's first ones."""
    return n - -(-percent * n // 100) + 1


def bitmap(one: np.ndarray) -> np.ndarray:
    """The token bitmap of one set, as words of 64 bits; a power of two, so that a wider one folds to a narrower one by OR."""
    width = BITMAP if len(one) <= NARROW else min(WIDEST, 1 << int(2 * len(one) - 1).bit_length())
    out = np.zeros(width, bool)
    out[(one >> np.uint64(20)).astype(np.int64) & (width - 1)] = True
    return np.packbits(out, bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (texts, words or more) made ``words`` words wide."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


def most_overlap(bits_a, size_a, bits_b, size_b):
    """The most shingles that sets of these bitmaps can share: each bit of one that the other lacks is at least one shingle alone."""
    alone_a = np.bitwise_count(bits_a & ~bits_b).sum(-1, dtype=np.int64)
    alone_b = np.bitwise_count(bits_b & ~bits_a).sum(-1, dtype=np.int64)
    return np.minimum(size_a - alone_a, size_b - alone_b)


def may_link(overlap, size_a, size_b, percent: int = PERCENT):
    return 100 * overlap >= percent * (size_a + size_b - overlap)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ``counts`` items of each owner: the owner and the place among the owner's items, of all items."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]


class SignatureForest:
    """Signature trees of many groups of rows at once.

    Rows of a group stand by size; LEAF neighbours are a leaf, FAN nodes the node above.  A node has the OR of its rows'
    token bitmaps, their range of sizes, the most shingles that a row of it has beyond its bits, and the range of its
    rows' classes.  A level is a set of arrays over the nodes of all trees.
    """

    def __init__(self, tree: np.ndarray, sizes: np.ndarray, bits: list[np.ndarray], classes: np.ndarray) -> None:
        self.rows = np.lexsort((sizes, tree))
        self.sizes, self.classes, self.wide = sizes, classes, bits
        words = BITMAP // 64
        self.bits = np.stack([folded(b, words) for b in bits]) if bits else np.zeros((0, words), np.uint64)
        tree, n = tree[self.rows], sizes[self.rows]
        slack = n - np.bitwise_count(self.bits[self.rows]).sum(1, dtype=np.int64)
        level = {"tree": tree, "low": n, "high": n, "slack": slack, "any": self.bits[self.rows], "first": classes[self.rows], "last": classes[self.rows]}
        self.levels = []
        step = LEAF
        while not self.levels or len(np.unique(level["tree"])) < len(level["tree"]):
            level = self._above(level, step)
            self.levels.append(level)
            step = FAN

    @staticmethod
    def _above(level: dict, step: int) -> dict:
        tree = level["tree"]
        begin = np.flatnonzero(np.concatenate(([True], tree[1:] != tree[:-1]))) if len(tree) else np.zeros(0, np.int64)
        count = np.diff(np.append(begin, len(tree)))
        owner, place = _spread(count)
        at = np.flatnonzero(place % step == 0)
        join = {"low": np.minimum, "high": np.maximum, "slack": np.maximum, "any": np.bitwise_or, "first": np.minimum, "last": np.maximum}
        out = {k: f.reduceat(level[k], at, axis=0) if len(at) else level[k][:0] for k, f in join.items()}
        return out | {"tree": tree[at], "at": at, "count": np.diff(np.append(at, len(tree)))}

    def pairs(self, percent: int = PERCENT, across: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row pairs that may link, by dual traversal of each tree with itself, or of the named pairs of trees: arrays of rows a, b.

        Of two nodes, sets share at most the smaller one's largest size, and at most as many shingles as their ORs have common
        bits, and those beyond the bits; a pair of nodes is pruned if that is too few for its smallest sizes, or if all their
        rows are of one class.  At most PAIRS pairs of a level are opened at once, so what is held is bounded.
        """
        top = self.levels[-1]
        if across is None:
            a = b = np.arange(len(top["tree"]))
        else:
            a, b = (np.searchsorted(top["tree"], side) for side in across)
        todo = [(len(self.levels) - 1, a[k : k + PAIRS], b[k : k + PAIRS]) for k in range(0, len(a), PAIRS)]
        while todo:
            depth, a, b = todo.pop()
            level = self.levels[depth]
            ok = self._open(level, a, b, percent)
            a, b = a[ok], b[ok]
            owner, place = _spread(level["count"][a] * level["count"][b])
            width = level["count"][b][owner]
            i, j = level["at"][a[owner]] + place // np.maximum(width, 1), level["at"][b[owner]] + place % np.maximum(width, 1)
            once = (a[owner] != b[owner]) | ((i < j) if depth == 0 else (i <= j))
            a, b = i[once], j[once]
            if depth:
                todo += [(depth - 1, a[k : k + PAIRS], b[k : k + PAIRS]) for k in range(0, len(a), PAIRS)]
            else:
                yield self._rows(self.rows[a], self.rows[b], percent)

    def _rows(self, a: np.ndarray, b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.minimum(self.sizes[a], self.sizes[b]), np.maximum(self.sizes[a], self.sizes[b])
        ok = (self.classes[a] != self.classes[b]) & (100 * low >= percent * high)
        a, b = a[ok], b[ok]
        ok = np.zeros(len(a), bool)
        for s in range(0, len(a), STEP):
            x, y = a[s : s + STEP], b[s : s + STEP]
            over = most_overlap(self.bits[x], self.sizes[x], self.bits[y], self.sizes[y])
            ok[s : s + STEP] = may_link(over, self.sizes[x], self.sizes[y], percent)
        return self._by_wide(a[ok], b[ok], percent)

    def _open(self, level: dict, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        low, high, slack = level["low"], level["high"], level["slack"]
        ok = (100 * high[a] >= percent * low[b]) & (100 * high[b] >= percent * low[a])
        ok &= (level["first"][a] != level["last"][a]) | (level["first"][b] != level["last"][b]) | (level["first"][a] != level["first"][b])
        left = np.flatnonzero(ok)
        for s in range(0, len(left), STEP):
            at = left[s : s + STEP]
            x, y = a[at], b[at]
            common = np.bitwise_count(level["any"][x] & level["any"][y]).sum(1, dtype=np.int64)
            most = np.minimum(np.minimum(high[x], high[y]), np.minimum(slack[x], slack[y]) + common)
            ok[at] = may_link(most, low[x], low[y], percent)
        return ok

    def _by_wide(self, a: np.ndarray, b: np.ndarray, percent: int):
        """The pairs again by their widest common bitmaps, where these are wider than the trees'."""
        width = np.array([len(x) for x in self.wide], np.int64)
        least = np.minimum(width[a], width[b]) if len(a) else np.zeros(0, np.int64)
        ok = least <= BITMAP // 64
        for w in np.unique(least[~ok]).tolist():
            at = np.flatnonzero(least == w)
            for s in range(0, len(at), part := max(1, STEP * BITMAP // 64 // w)):
                own = at[s : s + part]
                rows, where = np.unique(np.concatenate((a[own], b[own])), return_inverse=True)
                bits = np.stack([folded(self.wide[r], w) for r in rows])
                x, y = where[: len(own)], where[len(own) :]
                n, m = self.sizes[a[own]], self.sizes[b[own]]
                ok[own] = may_link(most_overlap(bits[x], n, bits[y], m), n, m, percent)
        return a[ok], b[ok]


def tree_links(ids, classes, sets, side=None, percent: int = PERCENT, every: bool = False) -> list[tuple[int, int]]:
    """Links among rows, or between those of side 0 and of side 1: (id, id).

    Each pair of rows in different classes that the trees don't prune is compared in full; pairs whose classes links found
    before have joined are left out, unless ``every`` link is asked for.
    """
    parent: dict[int, int] = {}

    def find(x):
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    side = np.zeros(len(ids), np.int64) if side is None else np.asarray(side, np.int64)
    two = len(side) > 0 and bool(side.any())
    if not len(ids) or (two and side.all()):
        return []
    forest = SignatureForest(side, np.array([len(x) for x in sets], np.int64), [bitmap(x) for x in sets], np.asarray(classes, np.int64))
    links = []
    found = forest.pairs(percent, (np.array([0]), np.array([1])) if two else None)
    for i, j in ((i, j) for a, b in found for i, j in zip(a.tolist(), b.tolist())):
        if ids[i] == ids[j]:
            continue
        x, y = find(classes[i]), find(classes[j])
        if x == y and not every:
            continue
        shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if may_link(shared, len(sets[i]), len(sets[j]), percent):
            parent[max(x, y)] = min(x, y)
            links.append((int(ids[i]), int(ids[j])))
    return links


# --- distributed part -------------------------------------------------------


def heavy_shingles(docs: DataFrame, id_col: str, text_col: str, words: int) -> np.ndarray:
    """Shingles of at least HEAVY_DOCS different texts of a bounded sample; only an order, so no link depends on it."""
    rows = docs.where(F.col(id_col).isNotNull())
    total = rows.count()
    if not total:
        return np.zeros(0, np.uint64)
    share = int(min(1.0, SAMPLE_DOCS / total) * 2**31)
    picked = rows.where(F.pmod(F.xxhash64(F.lit(3), F.col(id_col).cast("long")), F.lit(2**31)) < share).select(F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for part in T.chunks(batch):
                sets, at = shingle_sets(*T.buffers(part.column("text")), words)
                whole = set_sums(sets, at)[T.row_of(at)]
                yield pa.RecordBatch.from_arrays([pa.array(sets.view(np.int64)), pa.array(whole.view(np.int64))], ["token", "whole"])

    # Copies would make a whole text heavy: a token counts once for each different set.
    counts = picked.mapInArrow(T.tidied(run), "token long, whole long").distinct().groupBy("token").count().where(F.col("count") >= HEAVY_DOCS)
    return np.sort(counts.select("token").toPandas()["token"].to_numpy(np.int64).view(np.uint64))


def connected(edges: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """The smallest reachable node of every node of the ``(u, v)`` edges: ``node, component``.

    Large-star and small-star rounds, each written, until the edges stay as they are; no edge comes to the driver.
    """
    now = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name, paths)
    mark = _mark(now)
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))
        small = large.join(down, "u").select(F.explode(ends).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        now, before = written(small.where("u != v").distinct(), name, paths), mark
        if (mark := _mark(now)) == before:  # stars stay as they are
            return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.shiftrightunsigned(F.xxhash64("v", "u"), 32))).first())


def _prepared(base: DataFrame, heavy: np.ndarray, words: int, percent: int) -> DataFrame:
    """``id, n, k1, k2, prefix, bits`` of every row: the set's size, two digests, its first shingles in the common order, its bitmap."""

    def prepare(batches):
        for batch in batches:
            for part in T.chunks(batch):
                sets, at = shingle_sets(*T.buffers(part.column("text")), words)
                lens = np.diff(at)
                row = T.row_of(at)
                ordered = sets
                if len(heavy):
                    where = np.minimum(np.searchsorted(heavy, sets), len(heavy) - 1)
                    # Stable: by row, common shingles last, then by hash.
                    ordered = sets[np.lexsort((heavy[where] == sets, row))]
                size = np.where(lens > 0, prefix_size(lens, percent), 0)
                stop = np.cumsum(size)
                prefix = ordered[np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(at[:-1] - stop + size, size)]
                keys = [set_sums(x, at).view(np.int64) for x in (sets, T.mixed(sets ^ np.uint64(0xA5A5A5A5A5A5A5A5)))]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], stop)).astype(np.int32)), pa.array(prefix.view(np.int64)))
                bits = pa.array([bitmap(sets[a:b]).tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lens), *map(pa.array, keys), lists, bits], ["id", "n", "k1", "k2", "prefix", "bits"])

    return base.mapInArrow(T.tidied(prepare), "id long, n long, k1 long, k2 long, prefix array<long>, bits binary")


def _postings(kept: DataFrame, first: int | None = None) -> DataFrame:
    """``token, id, n, pos`` of the representatives' prefix shingles, or of the first ones alone; pos is the place in the prefix."""
    prefix = F.slice("prefix", 1, first) if first else F.col("prefix")
    return kept.select("id", "n", F.posexplode(prefix).alias("pos", "token")).select("token", "id", "n", "pos")


def _partnered(token: np.ndarray, ids: np.ndarray, n: np.ndarray, pos: np.ndarray, percent: int) -> np.ndarray:
    """Which rows of whole lists, by size, have a partner there that sizes and places allow.

    Two sets that link meet in the list of the first shingle that they share, and share at most what follows it in either.
    """
    after = np.searchsorted(token, token, "right") - 1 - np.arange(len(token))
    i, place = _spread(after)
    j = i + 1 + place
    ok = (ids[i] != ids[j]) & may_link(np.minimum(n[i] - pos[i], n[j] - pos[j]), n[i], n[j], percent)
    out = np.zeros(len(token), bool)
    out[i[ok]] = out[j[ok]] = True
    return out


def _blocks(postings: DataFrame, name: str, percent: int, paths: list[str]) -> DataFrame:
    """Posting lists of at least two rows, sorted by size and cut into blocks of at most BLOCK rows: with ``block``.

    Range partitions by token, size and id part a long list over several tasks; a list with rows in two partitions has a block
    in each.  Of lists of at most SHORT rows that lie in one partition, rows without a possible partner are left out.
    """
    names = ["token", "id", "n", "pos"]
    ordered = postings.select(*names).repartitionByRange("token", "n", "id").sortWithinPartitions("token", "n", "id")

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        held = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.int32)]
        border = True  # the first list of a partition may have begun in another, and so may the rest of one that was cut

        def cut(cols, last):
            """Blocks of whole lists, or of full blocks alone."""
            nonlocal number, border
            token = cols[0]
            begin = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            count = np.diff(np.append(begin, len(token)))
            owner, place = _spread(count)
            whole = np.ones(len(begin), bool)
            if border:
                whole[0] = False
            if last:
                whole[-1] = False
            border = False
            short = np.flatnonzero((whole & (count <= SHORT))[owner])
            keep = np.ones(len(token), bool)
            keep[short] = _partnered(*(c[short] for c in cols), percent)
            block = number + np.cumsum(place % BLOCK == 0)
            number = int(block[-1])
            return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (*cols, block)], [*names, "block"])

        for batch in batches:
            held = [np.concatenate((h, batch.column(i).to_numpy())) for i, h in enumerate(held)]
            token = held[0]
            at = int(np.searchsorted(token, token[-1])) if len(token) else 0  # the last list may go on
            if at:
                yield cut([h[:at] for h in held], False)
                held = [h[at:] for h in held]
            if full := len(held[0]) // BLOCK * BLOCK:
                border = True
                yield cut([h[:full] for h in held], False)
                held, border = [h[full:] for h in held], True
        if len(held[0]):
            yield cut(held, True)

    return written(ordered.mapInArrow(T.tidied(run), "token long, id long, n long, pos int, block long"), name, paths)


def _classed(members: DataFrame, classes: DataFrame | None) -> DataFrame:
    """List rows with the class ``comp`` of their id."""
    names = ["token", "id", "n", "pos", "block"]
    if classes is None:
        return members.select(*names, F.col("id").alias("comp"))
    return members.join(classes, F.col("id") == F.col("node"), "left").select(*names, F.coalesce("component", "id").alias("comp"))


def _one_of_class(members: DataFrame, classes: DataFrame, paths: list[str]) -> DataFrame:
    """One row of each class of every list that holds several; lists choose by a hash of their own, so a class shows many faces."""
    chosen = F.min_by(F.struct("id", "n", "pos"), F.xxhash64("token", "id"))
    one = written(_classed(members, classes).groupBy("token", "comp").agg(chosen.alias("r")).select("token", "r.*"), "one-of-class", paths)
    return one.join(one.groupBy("token").count().where("count > 1"), "token", "left_semi")


def _open_lists(members: DataFrame, classes: DataFrame | None, paths: list[str]) -> DataFrame:
    """The rows, with their class ``comp``, of the lists that hold several classes; of lists with equal rows one stays."""
    rows = _classed(members, classes)
    one, two = F.xxhash64(F.lit(1), "id"), F.xxhash64(F.lit(2), "id")
    digest = [F.count(F.lit(1)).alias("c"), F.bit_xor(one).alias("x"), F.sum(F.shiftrightunsigned(two, 32)).alias("y"), F.sum(two.bitwiseAND(F.lit(0xFFFFFFFF))).alias("z")]
    lists = rows.groupBy("token").agg(*digest, F.min("comp").alias("a"), F.max("comp").alias("b")).where("a != b")
    lists = lists.groupBy("c", "x", "y", "z").agg(F.min("token").alias("token")).select("token")
    return written(rows.join(lists, "token", "left_semi"), "open", paths)


def _bundled(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with a number by which about BUNDLE rows of whole ``key`` groups go to the trees together."""
    return rows.withColumn("bundle", F.pmod(F.xxhash64(key), F.lit(max(1, -(-rows.count() // BUNDLE)))))


def _forest_of(table: pa.Table, key: str) -> SignatureForest:
    number = np.unique(table.column(key).to_numpy(), return_inverse=True)[1]
    bits = [np.frombuffer(x, np.uint64) for x in table.column("bits").to_pylist()]
    return SignatureForest(number, table.column("n").to_numpy(), bits, table.column("comp").to_numpy())


def _nearest(percent: int):
    """For each row of a block the smallest other id that the trees leave to it: at most one pair a row."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        best = np.full(len(ids), np.iinfo(np.int64).max)
        hit = np.zeros(len(ids), bool)
        for a, b in _forest_of(table, "block").pairs(percent):
            np.minimum.at(best, a, ids[b])
            np.minimum.at(best, b, ids[a])
            hit[a] = hit[b] = True
        T.trim()
        pair = np.unique(np.sort(np.stack((ids[hit], best[hit])), axis=0), axis=1)
        return pa.table({"id": pair[1], "pivot": pair[0]})

    return run


def _light_round(rows: DataFrame, info: DataFrame, base: DataFrame, words: int, percent: int, paths: list[str]) -> DataFrame:
    """Links found by the trees of single blocks, verified by full sets: ``u, v``.  Not all, but few pairs a row."""
    joined = _bundled(rows, "block").join(info, "id")
    pairs = joined.groupBy("bundle").applyInArrow(_nearest(percent), "id long, pivot long").where("id != pivot").distinct()
    near = written(pairs, "near", paths)
    sets = written(_sets_of(base, near.select("id").union(near.select("pivot")).distinct(), words), "sets", paths)
    release(base.sparkSession)
    full = near.join(sets, "id").join(sets.select(F.col("id").alias("pivot"), F.col("shingles").alias("other")), "pivot")
    shared, both = F.size(F.array_intersect("shingles", "other")), F.size("shingles") + F.size("other")
    return written(full.where(100 * shared >= percent * (both - shared)).select(F.col("id").alias("u"), F.col("pivot").alias("v")), "links", paths)


def _exact_round(rows: DataFrame, info: DataFrame, base: DataFrame, words: int, percent: int, paths: list[str], every: bool = False) -> DataFrame:
    """All links that are left between classes of one list (or every link): ``u, v``.

    A list of one block is a task; of longer ones pairs of blocks are, those that sizes, classes and the ORs of their bitmaps leave.
    """
    per_block = rows.groupBy("token", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("comp").alias("first"), F.max("comp").alias("last"))
    long = per_block.groupBy("token").count().where("count > 1").select("token")
    alone = rows.join(long, "token", "left_anti").select(F.col("block").alias("task"), F.lit(0).alias("side"), "id", "n", "comp")
    parts = rows.join(long, "token", "left_semi")
    tasks = alone
    if not long.isEmpty():
        ors = parts.join(info, "id").groupBy("block").applyInArrow(_summary, "block long, any binary, slack long")
        nodes = written(per_block.join(long, "token", "left_semi").join(ors, "block"), "nodes", paths)
        right = nodes.select("token", *(F.col(c).alias(f"o_{c}") for c in nodes.columns if c != "token"))
        met = nodes.join(right, "token").where((F.col("block") <= F.col("o_block")) & (100 * F.col("high") >= percent * F.col("o_low")) & (100 * F.col("o_high") >= percent * F.col("low")))
        met = met.where("first != last or o_first != o_last or first != o_first").mapInArrow(_open_nodes(percent), "block long, o_block long")
        met = written(met.withColumn("task", -1 - F.monotonically_increasing_id()), "node-pairs", paths)
        ends = met.select("task", F.lit(0).alias("side"), "block").union(met.where("block != o_block").select("task", F.lit(1).alias("side"), F.col("o_block").alias("block")))
        sides = ends.join(parts.select("block", "id", "n", "comp"), "block").select("task", "side", "id", "n", "comp")
        tasks = written(alone.union(sides), "tasks", paths)
    maybe = _bundled(tasks, "task").join(info, "id").groupBy("bundle").applyInArrow(_tree_filter(percent), "task long, side int, id long, comp long")
    # Shingles of one passage give many lists that leave the same rows over: each such set of rows is compared once.
    left = maybe.groupBy("task").agg(F.sort_array(F.collect_list(F.struct("side", "id", "comp"))).alias("rows")).select("rows").distinct()  # at most 2 * BLOCK rows each
    # Numbered before the rows are parted: within one select with explode, each row would get a number of its own.
    left = left.withColumn("task", F.monotonically_increasing_id())
    left = written(left.select("task", F.explode("rows").alias("r")).select("task", "r.*"), "left")
    sets = written(_sets_of(base, left.select("id").distinct(), words), "sets", paths)
    release(base.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        cols = (table.column(c).to_pylist() for c in ("id", "comp"))
        links = tree_links(*cols, set_views(table.column("shingles")), table.column("side").to_numpy(), percent, every)
        T.trim()
        return pa.table({"u": pa.array([x for x, _ in links], pa.int64()), "v": pa.array([y for _, y in links], pa.int64())})

    return written(left.join(sets, "id").groupBy("task").applyInArrow(run, "u long, v long"), "tree-links", paths)


def _summary(table: pa.Table) -> pa.Table:
    """The OR of a block's bitmaps, and the most shingles that a row has beyond its bits."""
    forest = _forest_of(table, "block")
    ors, slack = np.bitwise_or.reduce(forest.bits, axis=0), (forest.sizes - np.bitwise_count(forest.bits).sum(1, dtype=np.int64)).max()
    return pa.table({"block": table.column("block")[:1], "any": pa.array([ors.tobytes()], pa.binary()), "slack": pa.array([int(slack)], pa.int64())})


def _open_nodes(percent: int):
    """Pairs of blocks whose most possible overlap is enough."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            col = lambda c: batch.column(c).to_numpy()
            ors = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("any", "o_any")]
            common = np.bitwise_count(ors[0] & ors[1]).sum(1, dtype=np.int64)
            most = np.minimum(np.minimum(col("high"), col("o_high")), np.minimum(col("slack"), col("o_slack")) + common)
            ok = pa.array(may_link(most, col("low"), col("o_low"), percent) | (col("block") == col("o_block")))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(ok) for c in ("block", "o_block")], ["block", "o_block"])

    return run


def _tree_filter(percent: int):
    """The rows of each task that may link to a row of another class, by the trees alone: rows, not pairs."""

    def run(table: pa.Table) -> pa.Table:
        task, side = table.column("task").to_numpy(), table.column("side").to_numpy()
        number = np.unique(task, return_inverse=True)[1]
        two = np.zeros(int(number.max()) + 1, bool)
        two[number[side == 1]] = True
        own = table.append_column("tree", pa.array(2 * number + side))
        forest = _forest_of(own, "tree")
        trees = np.unique(2 * number + side)  # the forest numbers its trees in this order
        single = np.flatnonzero(~two[trees // 2])
        paired = np.flatnonzero(two[trees // 2] & (trees % 2 == 0) & np.isin(trees + 1, trees))
        across = np.concatenate((single, paired)), np.concatenate((single, paired + 1))
        keep = np.zeros(len(task), bool)
        for a, b in forest.pairs(percent, across):
            keep[a] = keep[b] = True
        T.trim()
        return table.select(["task", "side", "id", "comp"]).filter(pa.array(keep))

    return run


def _joined(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int):
    """What both results stand on: all rows, the representatives of equal sets, and a maker of the representatives' posting lists."""
    heavy = heavy_shingles(docs, id_col, text_col, words)  # at most SAMPLE_DOCS documents' shingles / HEAVY_DOCS
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = written(_prepared(base, heavy, words, percent).withColumn("row", F.monotonically_increasing_id()), "shingles")
    keyed = rows.select("id", "n", "k1", "k2", "row").where("n > 0 and id is not null")
    least = F.min(F.struct("id", "row"))
    reps = written(keyed.groupBy("k1", "k2", "n").agg(least.alias("r")).select("k1", "k2", "n", F.col("r.id").alias("rep"), "r.row"), "reps")
    # Representatives keep their prefixes; rows with equal ids and different sets are all kept, under the one id.
    kept = rows.join(reps.select("row"), "row", "left_semi")
    return base, rows, keyed, reps, kept.select("id", "n", "bits", "prefix")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Classes of documents linked by Jaccard similarity of word shingles: ``id_col, n_shingles, component_id``.

    1. Each text's shingles are put in one common order, and its prefix, bitmap and set digest are written.
    2. Texts with equal sets become one representative (the smallest id), so copies cost nothing further.
    3. Any two similar sets share a shingle of their prefixes.  The representatives of a prefix shingle, by size and in blocks
       of BLOCK rows, stand in signature trees, whose dual traversal gives the pairs that may link; full sets decide.
    4. The first trees stand on the lists of each set's FIRST first shingles, and a row is held against one partner alone.
       The next ones stand on all lists that still hold several classes, with one row of each class.
    5. The last, exact round has all rows of such lists; of lists of several blocks all pairs of blocks that sizes, classes and
       the ORs of the bitmaps leave are traversed.  Rows are multiplied only by those pairs.
    6. Classes are the connected components of the links; no group is expanded into all its pairs, and no cap is set.

    Null and empty texts and texts without words have 0 shingles and stand alone (component is the own id).  Rows with a null
    id have a null component and link nothing; rows with equal ids are one node with the shingles of each.  An empty
    table gives an empty result; extra columns are ignored.
    """
    spark, paths, links_at = docs.sparkSession, [], []
    base, rows, keyed, reps, kept = _joined(docs, id_col, text_col, words, percent)
    info, links, classes = kept.select("id", "bits"), None, None

    def add(found):
        """Keep the links and join the classes anew."""
        nonlocal links, classes
        links = found if links is None else links.union(found)
        classes = written(connected(links, "classes", paths), "classes")

    first = _blocks(_postings(kept, FIRST), "first-lists", percent, paths)
    add(written(_light_round(_open_lists(first, None, paths), info, base, words, percent, paths), "links", links_at))
    dropped(spark, paths)
    lists_at: list[str] = []
    members = _blocks(_postings(kept), "lists", percent, lists_at)
    for _ in range(ROUNDS):
        some = _open_lists(_blocks(_one_of_class(members, classes, paths), "lists-of-classes", percent, paths), None, paths)
        found = written(_light_round(some, info, base, words, percent, paths), "links", links_at)
        n, rows_left = found.count(), some.count()
        if n:
            add(found)
        dropped(spark, paths)
        if 100 * n < rows_left or not n:  # another round would save little
            break
    found = _exact_round(_open_lists(members, classes, paths), info, base, words, percent, paths)
    if not found.isEmpty():
        add(found)
    dropped(spark, paths + lists_at + links_at)
    # Rows of equal sets, or of equal ids, share a class; the class id is the smallest id of any of them.
    same = keyed.drop("row").join(reps.drop("row"), ["k1", "k2", "n"]).select("id", "rep").distinct()
    repeated = keyed.groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").limit(1).count() > 0
    if repeated:
        edges = same.where("id != rep").select(F.col("id").alias("u"), F.col("rep").alias("v")).union(classes.select("node", "component"))
        full_classes = written(connected(edges, "repeats", paths), "classes").withColumnsRenamed({"node": "c_id"})
    else:
        full_classes = same.join(classes, F.col("rep") == F.col("node"), "left").select(F.col("id").alias("c_id"), F.coalesce("component", "rep").alias("component"))
    out = rows.select("id", "n").join(full_classes, (F.col("id") == F.col("c_id")) & (F.col("n") > 0), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def near_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The join itself: ``id_a, id_b`` with id_a < id_b, every linked pair of representatives of equal sets.

    As the exact round of :func:`near_classes`, from the start and with no pair left out; the result grows with the pairs that link.  Rows with a
    null id and texts without words link nothing; an empty table gives an empty result; extra columns are ignored.
    """
    base, _, _, _, kept = _joined(docs, id_col, text_col, words, percent)
    paths: list[str] = []
    members = _blocks(_postings(kept), "lists", percent, paths)
    found = written(_exact_round(_open_lists(members, None, paths), kept.select("id", "bits"), base, words, percent, paths, every=True), "all-links")
    dropped(docs.sparkSession, paths)
    return found.select(F.least("u", "v").alias("id_a"), F.greatest("u", "v").alias("id_b")).distinct()


#: Bits of the filter that says which ids may be needed: sized by their number, up to a bound.
FILTER_BITS, FILTER_MOST = 16, 1 << 26


def _sets_of(base: DataFrame, needed: DataFrame, words: int) -> DataFrame:
    """The full shingle sets of the needed ids: ``id, shingles``.

    A filter of at most FILTER_MOST bits goes to every task, so that most other texts aren't hashed again; the join after it
    is exact.
    """
    count = needed.count()
    size = 1 << 15
    while size < min(FILTER_BITS * count, FILTER_MOST):
        size *= 2
    place = F.pmod(F.xxhash64("id"), F.lit(size))
    cells = needed.select((place / 8).cast("int").alias("byte"), F.pow(F.lit(2), F.pmod(place, F.lit(8))).cast("int").alias("bit")).groupBy("byte").agg(F.bit_or("bit").alias("bits")).toPandas()  # at most FILTER_MOST / 8 rows
    flags = np.zeros(size // 8, np.uint8)
    flags[cells["byte"].to_numpy()] = cells["bits"].to_numpy()

    def run(batches):
        for batch in batches:
            at = batch.column("place").to_numpy()
            maybe = (flags[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            for part in T.chunks(batch.filter(pa.array(maybe.astype(bool)))):
                sets, at = shingle_sets(*T.buffers(part.column("text")), words)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(sets.view(np.int64)))], ["id", "shingles"])

    rows = base.where("doc_id is not null").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(size)).alias("place"))
    return rows.mapInArrow(T.tidied(run), "id long, shingles array<long>").where(F.size("shingles") > 0).join(needed, "id", "left_semi")


def set_views(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The sets of a list column without nulls, as views of its values: no Python number per shingle."""
    whole = column.combine_chunks()
    values, at = whole.values.to_numpy().view(np.uint64), whole.offsets.to_numpy()
    return [values[a:b] for a, b in zip(at[:-1], at[1:])]


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class of near copies: the one with the smallest id, then the smallest hash; a row without an id comes last.

    Columns as they are.  If ids repeat or are null, rows are numbered in that order and the numbers are joined, so that a row
    goes by its own text alone.
    """
    own = F.col(id_col).cast("long")
    if docs.groupBy(own.alias("id")).agg(F.count(F.lit(1)).alias("c")).where("c > 1 or id is null").isEmpty():
        rows, key = docs, id_col
    else:
        order = [own.asc_nulls_last(), F.xxhash64(*(F.col(c).cast("string") for c in docs.columns))]
        rows = written(docs.repartitionByRange(*order).sortWithinPartitions(*order), "ranked")
        rows, key = in_written_order(rows, "__place"), "__place"
    drop = near_classes(rows, key, text_col).where(F.col(key) != F.col("component_id")).select(F.col(key).alias("__drop"))
    return rows.join(drop, rows[key].cast("long") == F.col("__drop"), "left_anti").select(*docs.columns)
