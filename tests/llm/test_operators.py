"""The ten operators against brute force, exact round trips and edge cases."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from wayfold.llm import byte_bpe, entry, exact_dedup, langid, mixing, ngram_join, quality_model, quality_rules, sharding, token_file, toxicity
from wayfold.llm import text as T

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BPE, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def models(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    return {"lang": langid.train_on(docs, docs["doc_id"] >= 0, per_lang=20), "toxic": toxicity.train_on(docs, labels), "quality": quality_model.train_on(docs, labels)}


def odd_rows(spark):
    """Nulls in every column, empty and blank texts, equal texts, repeated rows, a long text, and columns with names used inside."""
    long = "word " * 30_000
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", None, 3), (4, "same text of six words here", "en", "s", 1), (5, "same text of six words here", "de", "s", 1), (5, "same text of six words here", "de", "s", 1), (None, "a text without an id", "en", "s", 1), (7, long, "en", "t", 1), (8, "²³ 😀 é", "fr", "t", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(1) for c in ("id", "n", "t", "h", "salt", "unit", "src", "order", "token", "part", "seq", "component", "rep", "bits", "hot_n")})


def operators(models):
    return {
        "dedup": lambda d: exact_dedup.exact_dedup(d), "lang": lambda d: langid.language_id(d, models["lang"]), "rules": quality_rules.quality_rules,
        "tokens": lambda d: token_file.token_digests(d, WORDS), "bpe": lambda d: byte_bpe.bpe_digests(d, BPE), "toxic": lambda d: toxicity.score_toxicity(d, models["toxic"]),
        "shards": lambda d: sharding.shard_documents(d, 4), "near": ngram_join.near_classes, "mix": mixing.mix_sources, "quality": lambda d: quality_model.score_quality(d, models["quality"]),
    }


NAMES = ("dedup", "lang", "rules", "tokens", "bpe", "toxic", "shards", "near", "mix", "quality")


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_and_empty_tables(spark, models, name):
    op = operators(models)[name]
    odd = odd_rows(spark)
    assert sorted(str(r["doc_id"]) for r in op(odd).collect()) == sorted(str(r["doc_id"]) for r in odd.collect())
    assert op(odd.limit(0)).count() == 0


def test_dedup_hot_group(spark, monkeypatch):
    rows = [(i, "hot text" if i % 3 == 0 else f"text {i}", "en", "s", 1) for i in range(900)]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0] == (897, 300, False) and got[897] == (897, 300, True) and got[1] == (1, 1, True) and len(got) == 900


@pytest.mark.parametrize("name", sorted(entry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    got = entry.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(duckdb.sql(f"SELECT {', '.join(cols)} FROM ({entry.ORACLE_SQL[name]})").fetchall())


def test_forward_backward_equals_plain_recursion():
    rng = np.random.default_rng(0)
    at, k = np.array([0, 1, 1, 200, 205]), 3
    scores, trans = rng.normal(size=(205, k)), rng.normal(size=(k, k))
    got = langid.forward_backward(scores, at, trans)
    for a, z in zip(at[:-1], at[1:]):
        e, s = np.exp(scores[a:z]), np.exp(trans)
        f, b = e.copy(), np.ones((z - a, k))
        for i in range(1, z - a):
            f[i] = (f[i - 1] @ s) * e[i]
            f[i] /= f[i].sum()
        for i in range(z - a - 2, -1, -1):
            b[i] = s @ (e[i + 1] * b[i + 1])
            b[i] /= b[i].sum()
        want = f * b
        assert np.allclose(got[a:z], want / np.maximum(want.sum(1, keepdims=True), 1e-300))


def test_language_accuracy_and_und(spark):
    rows = entry.op2_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    model = langid.fit(["the cat", "der hund"], ["en", "de"])
    assert langid.predict(model, pa.array([None, "12 ²", "the"]))[0][:2] == ["und", "und"]


def test_quality_counts_equal_plain_ones(texts):
    ids = list(texts)
    got = quality_rules.base_counts(*T.buffers(pa.array([texts[i] for i in ids])))
    for k, i in enumerate(ids):
        t, ws = texts[i], WORD.findall(texts[i])
        c = Counter(tuple(ws[j : j + 5]) for j in range(len(ws) - 4))
        cover = {x for j in range(len(ws) - 4) if c[tuple(ws[j : j + 5])] > 1 for x in range(j, j + 5)}
        lines = Counter(x for x in t.split("\n") if WORD.search(x))
        want = (len(ws), sum(map(len, ws)), sum(t.count(x) for x in "#*$%&|<>"), sum(n - 1 for n in lines.values()), len(cover))
        assert want == tuple(int(got[c][k]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))


def plain_references(rows):
    """Shares of the common words and of the character classes of each language, counted plainly."""
    words, classes = defaultdict(Counter), defaultdict(Counter)
    for t, lang in rows:
        if lang:
            words[lang].update(x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in WORD.findall(t))
            for c in t:
                if c.isascii() and not 33 <= ord(c) < 127:
                    continue
                kind = 3 if not c.isascii() else 2 if c.isdigit() else 0 if c.islower() else 1 if c.isupper() else 4 if c in ".,;:'\"?!()-" else 5
                classes[lang][kind] += 1
    out = {}
    for lang, c in words.items():
        total = c.total()
        out[lang] = (Counter({w: n for w, n in c.items() if n / total >= quality_rules.COMMON_SHARE}), total, [classes[lang][k] / classes[lang].total() for k in range(6)])
    return out


def test_references_and_verdicts_equal_plain_ones(spark, docs, monkeypatch):
    """All common words are found over several partitions, shares are exact, and the verdict follows from the distances."""
    monkeypatch.setattr(quality_rules, "COMMON_WORDS", 10**6)
    rows = [(r["text"] or "", r["lang"]) for r in docs.collect()]
    want = plain_references(rows)
    refs = quality_rules.language_references(docs.repartition(5))
    assert refs["langs"] == sorted(want)
    bins = {}
    for lang in want:
        for w in want[lang][0]:
            bins[int(T.span_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]))[0])] = w
    assert set(map(int, refs["keys"])) == set(bins)
    for k, lang in enumerate(refs["langs"]):
        assert refs["classes"][k] == pytest.approx(want[lang][2])
        for j, key in enumerate(refs["keys"]):
            if n := want[lang][0][bins[int(key)]]:
                assert refs["words"][k][j] == pytest.approx(n / want[lang][1])
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs, references=refs).collect()}
    names = {bins[int(key)]: j for j, key in enumerate(refs["keys"])}
    for r in docs.collect():
        t, g = r["text"] or "", got[r["doc_id"]]
        ws = WORD.findall(t)
        own = np.zeros(len(names) + 1)
        for x in ws:
            own[names.get("".join(c.lower() if c.isascii() else c for c in x), len(names))] += 1
        chars = sum(1 for c in t if not c.isascii() or 33 <= ord(c) < 127)
        if ws and r["lang"] in refs["langs"]:
            far = quality_rules.js_distance(own / own.sum(), refs["words"][refs["langs"].index(r["lang"])])
            assert g["word_distance"] == pytest.approx(far, abs=1e-9)
        odd = (len(ws) >= quality_rules.MIN_WORDS and g["word_distance"] > quality_rules.WORD_LIMIT) or (chars >= quality_rules.MIN_CHARS and g["class_distance"] > quality_rules.CLASS_LIMIT)
        assert g["kept"] == (not g["base_failed"] and not odd)


def test_js_distance():
    p = np.array([[0.5, 0.5, 0, 0]])
    assert quality_rules.js_distance(p, np.array([0, 0, 0.5, 0.5]))[0] == pytest.approx(1)
    assert quality_rules.js_distance(p, p[0])[0] == 0


def test_quality_rules_keep_clean_texts(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = entry.op3_quality_rules(spark, d).join(labels, "doc_id").where("n_words >= 10").collect()
    assert np.mean([r["kept"] for r in rows if r["quality"] == 1]) > 0.98
    assert np.mean([r["kept"] for r in rows if r["quality"] == 0]) < 0.15


@pytest.mark.parametrize("n", [0, 1, 63, 129, 70_000])
def test_rans_round_trip_and_checkpoints(n, monkeypatch):
    monkeypatch.setattr(token_file, "LANES", 64)
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 999)
    table = token_file.Table(token_file.scaled(np.bincount(ids, minlength=1000)))
    block = token_file.encode_block(table, ids)
    assert (token_file.decode_block(table, block) == ids).all()
    parts = [token_file.decode_block(table, block, i) for i in range(len(token_file.checkpoints(block)))]
    assert (np.concatenate(parts) == ids).all()
    if n > 60_000:
        assert len(parts) > 2
    with pytest.raises(ValueError):
        token_file.decode_block(table, block[:-9] + bytes([block[-9] ^ 1]) + block[-8:])


def test_token_file_equals_the_library(spark, texts):
    tk, at = Tokenizer.from_file(WORDS), 0
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in entry.op4_token_file(spark, SF).collect()}
    for i in sorted(texts):
        ids = tk.encode(texts[i], add_special_tokens=False).ids + [2]
        assert got[i] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_other_tokenizer_files_take_whole_texts():
    """A file of other rules isn't cut into word pieces: its ids are the library's all the same."""
    other = P.path("byte_bpe_50k.json")
    assert token_file.splits_by_words(WORDS) and not token_file.splits_by_words(other)
    texts = [*random_texts(200)[:200], "An Upper Case. Text,  with spaces", ""]
    tk = Tokenizer.from_file(other)
    ids, at = token_file.tokenize(other, *T.buffers(pa.array(texts)))
    assert all(tk.encode(t, add_special_tokens=False).ids == ids[at[i] : at[i + 1]].tolist() for i, t in enumerate(texts))


def random_texts(n):
    rnd = random.Random(4)
    parts = [*"aaabcdeeeHILnorst   \n\t'''sdmlrtve.,!?&%#*|019²½éÉü  \x1c\x85漢字😀_-AZ×÷́", "'s", "'ll", " The", "\r\n", "aaaa", "…."]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 50))) for _ in range(n)] + ["a" * 3000, "ab" * 2000, " " * 50, "", "<|endoftext|>. <|ENDOFTEXT|>"]


def test_tokenizers_on_random_texts():
    texts = random_texts(1500)
    tk = Tokenizer.from_file(WORDS)
    ids, at = token_file.tokenize(WORDS, *T.buffers(pa.array(texts)))
    assert all(tk.encode(t, add_special_tokens=False).ids == ids[at[i] : at[i + 1]].tolist() for i, t in enumerate(texts))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids, at = byte_bpe.encode_batch(BPE, pa.array(texts))
    assert all(enc.encode_ordinary(t) == ids[at[i] : at[i + 1]].tolist() for i, t in enumerate(texts))
    assert [b.decode() for b in byte_bpe.decode_batch(BPE, ids, at)] == texts
    assert all(byte_bpe.encode_one(byte_bpe.vocabulary(BPE), x.encode()) == enc.encode_ordinary(x) for x in ("aaaa" * 40, "unbelievable", " the"))


def test_byte_bpe_digests(spark, texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = {r["doc_id"]: r for r in entry.op5_byte_bpe(spark, SF).collect()}
    assert len(rows) == len(texts)
    for i, t in texts.items():
        ids = enc.encode_ordinary(t)
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
        assert (rows[i]["n_tokens"], rows[i]["ids_sha256"], rows[i]["decoded_sha256"]) == want


def thue_morse(n):
    """A word and its complement: sums of byte powers modulo 2^64 can't part them."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return [word, word.translate(str.maketrans("ab", "ba"))]


@pytest.mark.parametrize("n", [512, 1024, 2048])
def test_hashes_part_regular_words(spark, n):
    pair = thue_morse(n)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids, at = byte_bpe.encode_batch(BPE, pa.array(pair))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [enc.encode_ordinary(x) for x in pair]
    tk = Tokenizer.from_file(WORDS)
    ids, at = token_file.tokenize(WORDS, *T.buffers(pa.array(pair)))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [tk.encode(x, add_special_tokens=False).ids for x in pair]
    got = ngram_join.near_classes(spark.createDataFrame([(i, x, "en", "s", 1) for i, x in enumerate(pair)], SCHEMA)).collect()
    assert sorted(r["component_id"] for r in got) == [0, 1]


def test_equal_first_hashes_are_told_apart(monkeypatch):
    """Were the first hashes of different pre-tokens equal, the second ones say so and each is encoded by itself."""
    whole = T.span_hashes
    monkeypatch.setattr(T, "span_hashes", lambda data, a, b, seed=0: whole(data, a, b, seed) if seed else whole(data, a, b) % np.uint64(7))
    byte_bpe._state.pop(("cache", BPE), None)
    token_file._state.clear()
    texts = ["one two three four five six seven eight nine ten eleven", "twelve, thirteen. one"]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tk = Tokenizer.from_file(WORDS)
    for _ in range(2):
        ids, at = byte_bpe.encode_batch(BPE, pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [enc.encode_ordinary(x) for x in texts]
        ids, at = token_file.tokenize(WORDS, *T.buffers(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [tk.encode(x, add_special_tokens=False).ids for x in texts]
    byte_bpe._state.pop(("cache", BPE), None)
    token_file._state.clear()


@pytest.mark.parametrize("ranks", [1, 64, 65, 4096, 262_144, 300_000])
def test_rank_queue_pops_in_order(ranks):
    queue, rnd = byte_bpe.RankQueue(ranks), random.Random(ranks)
    pushed = [(rnd.randrange(ranks), i) for i in range(200)] + [(ranks - 1, 200)]
    queue.push(np.array([r for r, _ in pushed[:90]]), np.array([i for _, i in pushed[:90]]))
    queue.push(np.array([r for r, _ in pushed[90:]]), np.array([i for _, i in pushed[90:]]))
    got = []
    while (x := queue.pop()) is not None:
        got += [(x[0], int(i)) for i in x[1]]
    assert got == sorted(pushed)


def test_one_pre_token_by_the_queue():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(2)
    for x in ["a" * 500, "ababa" * 30, "", *("".join(rnd.choice("aabcdeoth ") for _ in range(120)) for _ in range(30))]:
        assert byte_bpe.encode_one(byte_bpe.vocabulary(BPE), x.encode()) == (enc._encode_single_piece(x) if x else [])


def test_toxicity_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    rows = entry.op6_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").withColumnRenamed("toxic", "label"), "doc_id").where("held_out").collect()
    assert np.mean([r["toxic"] for r in rows if r["label"] == 1]) > 0.85
    assert np.mean([r["toxic"] for r in rows if r["label"] == 0]) < 0.02


def test_chain_is_fed_out_of_fold_probabilities(monkeypatch):
    """A fold's terms, categories and models never see its documents; prediction is the plain chain of logistic models."""
    rnd = random.Random(5)
    good, bad = [f"calm{i}x" for i in range(40)], [f"vile{i}x" for i in range(12)]
    texts, mark = [], []
    for i in range(240):
        toxic = i % 4 == 0
        texts.append(" ".join(rnd.choice(good) for _ in range(12)) + (" " + " ".join(rnd.sample(bad, 5)) if toxic else ""))
        mark.append(float(toxic))
    fold = (T.mixed(np.arange(240, dtype=np.uint64)) % np.uint64(toxicity.FOLDS)).astype(int)
    seen = []
    whole = toxicity._telling
    monkeypatch.setattr(toxicity, "_telling", lambda keys, b, g, nb, ng: seen.append((nb, ng)) or whole(keys, b, g, nb, ng))
    model = toxicity.fit(texts, np.array(mark))
    assert seen == [(sum(m for m, f in zip(mark, fold) if f != k), sum(1 - m for m, f in zip(mark, fold) if f != k)) for k in range(toxicity.FOLDS)] + [(60.0, 180.0)]
    p = toxicity.predict(model, pa.array(texts))
    for i in (0, 1, 7, 100):
        keys = set()
        for w in re.findall(r"[A-Za-z]+", texts[i]):
            data = np.frombuffer(w.encode(), np.uint8)
            _, h = toxicity.terms(data, np.array([0, len(data)]))
            keys |= set(h.tolist())
        on = [j for j, key in enumerate(model["keys"].tolist()) if key in keys]
        before = []
        for j, w in enumerate(model["chain"]):
            z = sum(w[k] for k in on) + sum(a * b for a, b in zip(before, w[len(model["keys"]) : -1])) + w[-1]
            before.append(1 / (1 + np.exp(-z)))
            assert p[i, j] == pytest.approx(before[-1])
    assert all((p[i, -1] > 0.5) == bool(mark[i]) for i in range(240))


def plain_capacity(sizes, shards):
    def fits(c):
        used, now = 1, 0
        for s in sizes:
            if s > c:
                return False
            if now + s > c:
                used, now = used + 1, 0
            now += s
        return used <= shards

    c = max(sizes)
    while not fits(c):
        c += 1
    return c


def test_minimax_cuts_equal_plain_search():
    rnd = random.Random(1)
    for _ in range(60):
        sizes, shards = [rnd.randint(1, 40) for _ in range(rnd.randint(1, 40))], rnd.randint(1, 7)
        cuts, capacity = sharding.minimax_cuts(np.array(sizes), shards)
        parts = [sum(sizes[a:b]) for a, b in zip([0, *cuts], [*cuts, len(sizes)])]
        assert capacity == plain_capacity(sizes, shards) and max(parts) <= capacity and sum(parts) == sum(sizes) and len(parts) == shards


def test_shards(spark, texts):
    rows = entry.op7_sharding(spark, SF).collect()
    slots, where = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        where[texts[r["doc_id"]]].add(r["shard"])
        assert r["size"] == len(texts[r["doc_id"]].encode()) + 8 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and all(len(x) == 1 for x in where.values())


@pytest.mark.parametrize("seed", range(6))
def test_shards_are_the_minimum_of_the_groups(spark, monkeypatch, seed):
    """The largest shard is as small as contiguous shards of whole groups can be, though the first cells hold many groups."""
    monkeypatch.setattr(sharding, "FIRST_BITS", 3)
    monkeypatch.setattr(sharding, "MORE_BITS", 2)
    rnd = random.Random(seed)
    texts = [f"{rnd.randint(0, 60)} " + "x" * (0 if seed % 2 else 5) for _ in range(200)] + (["hot" * 9] * 150 if seed > 3 else [])
    df = spark.createDataFrame([(i, t * (1 + len(t) % 3), "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    rows = sharding.shard_documents(df, 5).collect()
    size, of = Counter(), {r["doc_id"]: r for r in rows}
    for r in rows:
        size[r["shard"]] += r["size"]
    keyed = df.selectExpr("xxhash64(text) AS h", "doc_id").collect()
    groups = Counter()
    for r in keyed:
        groups[r["h"]] += of[r["doc_id"]]["size"]
    assert max(size.values()) == plain_capacity([groups[h] for h in sorted(groups)], 5)


def test_shards_hot_unit(spark):
    rows = [(i, "hot" if i < 3000 else f"text {i}", "en", "s", 1) for i in range(6000)]
    slots = defaultdict(list)
    for r in sharding.shard_documents(spark.createDataFrame(rows, SCHEMA), 4).collect():
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and sum(map(len, slots.values())) == 6000


def plain_classes(texts, percent=80):
    sets = {}
    for i, t in texts.items():
        ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            o = len(sets[i] & sets[j])
            if o and 100 * o >= percent * (len(sets[i]) + len(sets[j]) - o):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_rows(rnd, n):
    """Families of edited copies around the threshold, and passages that many texts share."""
    words = lambda k: [f"w{rnd.randint(0, 5000)}" for _ in range(k)]
    shared, bases, out = words(60), [words(rnd.randint(20, 80)) for _ in range(6)], []
    for i in range(n):
        base = list(rnd.choice(bases)) if i % 2 else words(30)
        for _ in range(rnd.randint(0, 4)):
            base[rnd.randrange(len(base))] = "x" + str(rnd.random())
        out.append(" ".join(base + (shared if i % 5 == 0 else [])))
    return out


@pytest.mark.parametrize("seed,block", [(1, None), (2, None), (3, 2), (4, 8)])
def test_near_classes_equal_all_pairs(spark, monkeypatch, seed, block):
    if block:  # lists of several blocks, and no light rounds but one: the exact round does the rest
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        monkeypatch.setattr(ngram_join, "ROUNDS", 0)
    rnd = random.Random(seed)
    texts = dict(enumerate(near_rows(rnd, 150) + ["a b c", "A  b\nc", "a b", "", "one two three four five"]))
    got = ngram_join.near_classes(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts.items()], SCHEMA)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain_classes(texts)


def test_tree_links_join_all_classes(monkeypatch):
    monkeypatch.setattr(ngram_join, "LEAF", 2)
    texts = near_rows(random.Random(9), 80)
    sets, at = ngram_join.shingle_sets(*T.buffers(pa.array(texts)))
    own = [sets[a:b] for a, b in zip(at[:-1], at[1:])]
    ids = list(range(len(texts)))
    want = {i: c for i, (_, c) in plain_classes(dict(enumerate(texts))).items()}

    def classes(links):
        parent = list(ids)
        for a, b in links:
            x, y = a, b
            while parent[x] != x:
                x = parent[x]
            while parent[y] != y:
                y = parent[y]
            parent[max(x, y)] = min(x, y)
        return {i: (lambda x: [x := parent[x] for _ in ids][-1])(i) for i in ids}

    assert classes(ngram_join.tree_links(ids, ids, own)) == want
    side = np.arange(len(ids)) >= 40
    halves = [ngram_join.tree_links(ids[a:b], ids[a:b], own[a:b]) for a, b in ((0, 40), (40, 80))]
    assert classes(halves[0] + halves[1] + ngram_join.tree_links(ids, ids, own, side)) == want
    every = {tuple(sorted(x)) for x in ngram_join.tree_links(ids, ids, own, every=True)}
    assert every == plain_links(own) and len(every) > 5


def pairs_of(chunks):
    return [p for a, b in chunks for p in zip(a.tolist(), b.tolist())]


def plain_links(sets):
    out = set()
    for i, a in enumerate(sets):
        for j in range(i):
            o = len(np.intersect1d(a, sets[j]))
            if o and 100 * o >= 80 * (len(a) + len(sets[j]) - o):
                out.add((j, i))
    return out


@pytest.mark.parametrize("leaf,fan", [(1, 2), (2, 3), (16, 4)])
def test_forest_loses_no_pair(monkeypatch, leaf, fan):
    """All pairs of a tree, or across two, that link are among those which the traversal leaves; most others aren't."""
    monkeypatch.setattr(ngram_join, "LEAF", leaf)
    monkeypatch.setattr(ngram_join, "FAN", fan)
    monkeypatch.setattr(ngram_join, "PAIRS", 7)
    rnd = random.Random(3)
    texts = near_rows(rnd, 90) + [" ".join(f"v{rnd.randint(0, 10**6)}" for _ in range(k)) for k in (500, 600, 700, 1500)]
    texts += [texts[-1] + " more words", texts[-2].replace("v1", "v2"), texts[-4]]
    sets, at = ngram_join.shingle_sets(*T.buffers(pa.array(texts)))
    own = [sets[a:b] for a, b in zip(at[:-1], at[1:])]
    tree = np.array([rnd.randint(0, 2) for _ in texts])
    forest = ngram_join.SignatureForest(tree, np.array([len(x) for x in own]), [ngram_join.bitmap(x) for x in own], np.arange(len(own)))
    links = plain_links(own)
    found = [tuple(sorted(p)) for p in pairs_of(forest.pairs())]
    assert len(found) == len(set(found)) and {p for p in links if tree[p[0]] == tree[p[1]]} <= set(found) and all(tree[i] == tree[j] for i, j in found)
    cross = {tuple(sorted(p)) for p in pairs_of(forest.pairs(across=(np.array([0]), np.array([2]))))}
    assert {p for p in links if {tree[p[0]], tree[p[1]]} == {0, 2}} <= cross and len(cross) < 700
    same = ngram_join.SignatureForest(tree, np.array([len(x) for x in own]), [ngram_join.bitmap(x) for x in own], np.zeros(len(own), np.int64))
    assert not pairs_of(same.pairs())


def test_near_links_are_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    texts = dict(enumerate(near_rows(random.Random(4), 120) + ["a b c", "", "A b  c"]))
    sets, at = ngram_join.shingle_sets(*T.buffers(pa.array(list(texts.values()))))
    own = [sets[a:b] for a, b in zip(at[:-1], at[1:])]
    first = {}
    for i, x in enumerate(own):
        first.setdefault(x.tobytes(), i)
    got = ngram_join.near_links(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts.items()], SCHEMA)).collect()
    assert {tuple(r) for r in got} == {p for p in plain_links(own) if all(first[own[k].tobytes()] == k for k in p)}


def test_lists_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    rnd = random.Random(8)
    rows = [(rnd.randint(1, 6), i, 9, 0) for i in range(40)] + [(100 + i, i, 1, 0) for i in range(30)] + [(200, 1, 10, 0), (200, 2, 99, 0), (201, 1, 100, 30), (201, 2, 100, 0)]
    got = ngram_join._blocks(spark.createDataFrame(rows, "token long, id long, n long, pos int").repartition(5), "t", 80, []).collect()
    blocks = defaultdict(list)
    for r in got:
        blocks[r["block"]].append(r)
    assert all(len(b) <= 3 and len({r["token"] for r in b}) == 1 for b in blocks.values())
    found = {tuple(r)[:4] for r in got}
    assert found >= set(rows[:40]) and len(got) == len(found) and len([r for r in got if r["token"] > 99]) < 12


def test_partners_by_size_and_place():
    token, ids = np.array([1, 1, 1, 2, 2, 3, 3]), np.array([1, 2, 3, 1, 2, 1, 1])
    n, pos = np.array([10, 80, 100, 100, 100, 50, 50]), np.array([0, 0, 0, 0, 12, 0, 0])
    assert ngram_join._partnered(token, ids, n, pos, 80).tolist() == [False, True, True, False, False, False, False]
    pos[4] = 11
    assert ngram_join._partnered(token, ids, n, pos, 80)[3:5].all()


def test_set_views():
    table = pa.table({"side": [0, 1, 0, 1], "s": pa.array([[1, -2], [3], [], [4, 5]], pa.list_(pa.int64()))})
    parts = pa.concat_tables([table, table])
    for side, expected in ((0, [[1, 2**64 - 2], []] * 2), (1, [[3], [4, 5]] * 2), (2, [])):
        found = ngram_join.set_views(parts.filter(pa.array(np.isin(parts["side"].to_numpy(), side)))["s"])
        assert [x.tolist() for x in found] == expected


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (50, 70), (200, 201)]
    got = {r["node"]: r["component"] for r in ngram_join.connected(spark.createDataFrame(edges, "u long, v long"), "t").collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[100] == got[70] == 50 and got[201] == 200


def plain_shares(sizes, weights, total, most=3):
    """Rounds of sharing: whoever is over its limit gets that and leaves."""
    out, left, still = [0.0] * len(sizes), float(total), [i for i, n in enumerate(sizes) if n]
    while still:
        unit = left / sum(weights[i] for i in still)
        over = [i for i in still if weights[i] * unit >= most * sizes[i]]
        for i in over or still:
            out[i] = most * sizes[i] if over else weights[i] * unit
        left, still = left - sum(out[i] for i in over), [i for i in still if i not in over] if over else []
    return out


@pytest.mark.parametrize("sizes", [[100, 100, 100], [10, 100, 190], [1, 1, 1000, 3, 7], [0, 5, 0, 9], [7], [0, 0], [1000, 1, 1, 1, 1, 1, 1, 2000]])
def test_capped_shares(spark, sizes):
    rows = mixing.capped_shares(spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "key string, size long")).collect()
    got = [r["target"] or 0.0 for r in sorted(rows, key=lambda r: r["nth"])]
    assert got == pytest.approx(plain_shares(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))], sum(sizes)))


def test_positions_invert_the_schedule(spark):
    """The words of a source before a position are the integral of its weight up to there."""
    rnd = random.Random(3)
    rows = [(i, "w " * rnd.randint(1, 9), "en", f"s{i % 3}", 1) for i in range(900)]
    mix = mixing.mix_sources(spark.createDataFrame(rows, SCHEMA)).collect()
    by = defaultdict(list)
    for r in mix:
        by[r["source"]] += [(p, r["size"]) for p in r["positions"]]
        assert len(r["positions"]) == r["copies"] and all(0 <= p <= 1 for p in r["positions"])
    for k, (a, b) in enumerate(mixing.SCHEDULES):
        taken, total = sorted(by[f"s{k}"]), sum(n for _, n in by[f"s{k}"])
        for t in (0.1, 0.25, 0.5, 0.75, 0.9):
            want = (a * t + (b - a) * t * t / 2) / ((a + b) / 2)
            assert sum(n for p, n in taken if p <= t) / total == pytest.approx(want, abs=0.01)
    with pytest.raises(ValueError):
        mixing.mix_sources(spark.createDataFrame(rows[:1], SCHEMA), most=2.5)


def test_op9_takes_what_the_curriculum_places(spark, monkeypatch):
    from pyspark.sql import functions as F

    d, mix = "/root/testdata/sf0.001", mixing.mix_sources
    taken = lambda: {r["doc_id"]: (r["taken"], r["size"]) for r in entry.op9_mixing(spark, d).collect()}
    whole = taken()
    monkeypatch.setattr(mixing, "mix_sources", lambda docs: mix(docs).withColumn("positions", F.transform("positions", lambda p: p + F.when(F.col("copies") > 1, 2.0).otherwise(0.0))))
    assert any(n > size for n, size in whole.values())
    assert taken() == {k: (0 if n > size else n, size) for k, (n, size) in whole.items()}


def test_mix_meets_targets_and_schedule(spark):
    d = "/root/testdata/sf0.01"
    rows = entry.op9_mixing(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source"), "doc_id").collect()
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
        assert r["taken"] <= 3 * r["size"]
    for part in by.values():
        assert abs(sum(r["taken"] for r in part) - part[0]["target"]) <= max(r["size"] for r in part)
    assert abs(sum(x[0]["target"] for x in by.values()) - sum(r["size"] for r in rows)) < 1


def test_quality_model_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    rows = entry.op10_quality_model(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] for r in rows if r["quality"] == 1]) > 0.97
    assert np.mean([r["predicted"] for r in rows if r["quality"] == 0]) < 0.2


def test_pipeline(spark, docs):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF).collect()
    assert out and all(len(r["ids"]) == r["n_tokens"] for r in out)
    now, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        nxt = stage(spark, now, SF)
        assert nxt.columns == columns, name
        now = nxt.cache()
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in now.collect()}


def plain_copies(rows):
    """How often the mix takes each (id, source, size), document by document."""
    names = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, x, n in rows if x == s) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target = dict(zip(names, plain_shares([size[s] for s in names], [weight[s] for s in names], sum(size.values()))))
    out = {}
    for s in names:
        at = 0
        whole = int(target[s] / size[s] + 1e-9) if size[s] else 0
        for i, _, n in sorted((r for r in rows if r[1] == s), key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest()):
            again = whole < 3 and at + n / 2 < target[s] - whole * size[s]
            out[i], at = (min(3, whole + again) if n else 0), at + n
    return out


def test_pipeline_equals_plain_one(spark, docs):
    import corpus_pipeline

    rows = {r["doc_id"]: r for r in docs.collect()}
    model = toxicity.train_on(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    now = [i for i in sorted(rows) if toxicity.predict(model, pa.array([rows[i]["text"]], pa.string()))[0, -1] < toxicity.THRESHOLD]
    first = {}
    for i in now:
        first.setdefault(rows[i]["text"] or "", i)
    now = sorted(first.values())
    classes = plain_classes({i: rows[i]["text"] or "" for i in now})
    now = [i for i in now if classes[i][1] == i]
    copies = plain_copies([(i, rows[i]["source"], len(WORD.findall(rows[i]["text"] or ""))) for i in now])
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r["doc_id"] for r in got) == Counter({i: n for i, n in copies.items() if n})
    assert all(list(r["ids"]) == enc.encode_ordinary(rows[r["doc_id"]]["text"]) for r in got)


def test_repeated_ids_keep_their_other_texts(spark):
    import corpus_pipeline

    rows = [(1, "a text that stands alone", "en", "s", 1), (3, "copied", "en", "s", 1), (5, "copied", "en", "s", 1), (5, "another text with this id", "en", "s", 1), (None, "copied", "en", "s", 1), (7, None, "en", "s", 1), (8, "", "en", "s", 1)]
    got = corpus_pipeline.drop_copies(spark, spark.createDataFrame(rows, SCHEMA), SF).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted([(1, rows[0][1]), (3, "copied"), (5, rows[3][1]), (7, None)], key=repr)


def test_training_order_survives_several_files(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(5)
    rows = [(i, " ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(rnd.randint(1, 40) * (1 + 9 * (i % 2)))), "en", f"s{i % 3}", 1) for i in range(600)]
    docs = spark.createDataFrame(rows, SCHEMA)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        corpus_pipeline.mix(spark, docs, SF).write.option("maxRecordsPerFile", 70).parquet(path := str(tmp_path / "mixed"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    mixed = spark.read.parquet(path)
    assert mixed.select("_metadata.file_name").distinct().count() > 4
    got = corpus_pipeline.tokenize(spark, mixed, SF)
    got.write.parquet(out := str(tmp_path / "tokens"))
    got = {r["position"]: r["doc_id"] for r in spark.read.parquet(out).collect()}
    plan = sorted((at, r["doc_id"]) for r in mixing.mix_sources(docs).collect() for at in r["positions"])
    assert [got[k] for k in range(len(got))] == [i for _, i in plan]


def test_curriculum_takes_rows_with_null_and_repeated_ids(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice([None, None, *range(6)]), " ".join(["w"] * n), "en", rnd.choice("abc"), n) for n in range(1, 61)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    plan = mixing.mix_sources(docs).collect()
    got = mixing.curriculum(docs)
    assert got.columns == docs.columns
    taken = Counter(got.collect())
    assert {r["n_chars"]: n for r, n in taken.items()} == {r["size"]: r["copies"] for r in plan if r["copies"]}
    assert {tuple(r) for r in taken} <= set(rows) and any(r["doc_id"] is None for r in taken)
    words = Counter()
    for r, n in taken.items():
        words[r["source"]] += n * r["n_chars"]
    assert all(abs(words[r["source"]] - r["target"]) <= 60 for r in plan)


def test_one_row_of_each_group_of_copies_stays(spark):
    import corpus_pipeline

    base = [f"w{i}" for i in range(60)]
    near = " ".join([*base[:-1], "x"])
    rows = [(4, " ".join(base), "en", "s", 1), (4, " ".join(base), "en", "s", 1), (4, " ".join(base), "de", "t", 1), (9, near, "en", "s", 1), (9, "an own text with id nine", "en", "s", 1)]
    rows += [(None, "no id here but copied", "en", "s", 1)] * 3 + [(None, near + " y", "en", "s", 1), (2, "another text", "en", "s", 1), (2, "yet other words", "en", "s", 1)]
    one = corpus_pipeline.drop_copies(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), SF)
    assert one.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert Counter((r["doc_id"], r["text"]) for r in one.collect()) == Counter({(r[0], r[1]) for r in rows})
    left = corpus_pipeline.drop_near_copies(spark, one, SF)
    expected = {(4, rows[0][1]), (9, rows[4][1]), (None, rows[5][1]), (2, "another text"), (2, "yet other words")}
    assert left.columns == one.columns and Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter(expected)


def test_prediction_equals_plain_chain():
    """Languages and scores are those of the textbook recursion over the letter runs of a text."""
    rnd = random.Random(11)
    words = {"aa": ["kato", "miro", "salu"], "bb": ["thorn", "wreck", "stilt"], "cc": ["\u00e9lan", "\u00fcber", "\u00f1oq"]}
    texts, langs = [], []
    for i in range(60):
        lang = sorted(words)[i % 3]
        texts.append(" ".join(rnd.choice(words[lang]) for _ in range(20)))
        langs.append(lang)
    model = langid.fit(texts, langs)
    mixed = ["kato thorn miro wreck, salu! 12 stilt", "thorn " * 150 + "kato " * 20, "Kato", ""]
    got, score = langid.predict(model, pa.array(mixed))
    for k, text in enumerate(mixed):
        runs = [w.encode() for w in re.findall(r"[A-Za-z\u0080-\uffff]+", text)]
        if not runs:
            assert got[k] == "und" and score[k] == 0
            continue
        data = np.frombuffer(b" ".join(runs), np.uint8)
        ends = np.cumsum([len(r) + 1 for r in runs]) - 1
        e = np.exp(langid.emissions(model, data, ends - [len(r) for r in runs], ends))
        s, f, b = np.exp(model["trans"]), e.copy(), np.ones_like(e)
        for i in range(1, len(e)):
            f[i] = (f[i - 1] @ s) * e[i]
            f[i] /= f[i].sum()
        for i in range(len(e) - 2, -1, -1):
            b[i] = s @ (e[i + 1] * b[i + 1])
            b[i] /= b[i].sum()
        p = f * b / (f * b).sum(1, keepdims=True)
        mean = (p * np.array([[len(r)] for r in runs])).sum(0) / sum(map(len, runs))
        assert got[k] == model["langs"][int(np.argmax(mean))] and score[k] == pytest.approx(mean.max(), abs=1e-9)


def test_quality_calibration_and_pooling():
    """Vectors pool to the mean over words, the temperature is the one of the least loss, and scores follow from the network."""
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(("good", "fine", "plain") if i % 2 else ("BUY", "spam", "$$$")) for _ in range(rnd.randint(5, 30))) for i in range(200)]
    model = quality_model.fit(texts, np.arange(200) % 2)
    known = dict(zip(model["keys"].tolist(), model["vectors"]))
    for text in (texts[0], texts[1], "good good unseen"):
        data, at = T.buffers(pa.array([text]))
        h = quality_model.tokens(data, at)[0]
        each = [known.get(x, quality_model.index_vectors(np.array([x], np.uint64))[0] / np.sqrt(quality_model.PLACES)) for x in h.tolist()]
        mean = np.mean(each, 0)
        x = np.concatenate((mean, [np.linalg.norm(mean), np.log1p(len(h)), len(set(h.tolist())) / len(h), max(Counter(h.tolist()).values()) / len(h)]))
        x = (x - model["mean"]) / model["scale"]
        net = model["net"]
        z = np.maximum(x @ net["w1"] + net["b1"], 0) @ net["w2"] + net["b2"]
        assert quality_model.predict(model, pa.array([text]))[0] == pytest.approx(1 / (1 + np.exp(-z / model["temperature"])), rel=1e-4)
    score = quality_model.predict(model, pa.array(texts))
    assert np.mean((score > 0.5) == (np.arange(200) % 2 == 1)) > 0.97 and 0.25 <= model["temperature"] <= 8


def test_every_language_is_learned(spark):
    word = lambda k, j: "".join(chr(97 + (k * 7 + j * 5 + i * (k + 3)) % 26) for i in range(6)) + chr(97 + k % 26) + chr(97 + k // 26)
    rows = [(100 * k + n, " ".join(word(k, j) for j in range(8)), f"l{k:02}", "s", 1) for k in range(70) for n in range(2 if k > 63 else 3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert langid.train_on(docs, docs["doc_id"] >= 0)["langs"] == sorted({r[2] for r in rows})


CLASHES = ("toxic", "p_toxic", "p_severe", "id", "kept", "position", "place", "tie", "row", "n", "token", "h", "shard")


def test_stages_keep_odd_rows_and_columns(spark, tmp_path):
    """Nulls, empty texts, repeated rows and clashing columns through every stage; values are those of the docstrings."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    long = " ".join(f"w{i}" for i in range(3000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n ", "en", None, 3), (4, "the first text of six words", "en", "s", 1), (4, "the first text of six words", "en", "s", 1),
        (None, "a text without an id stays", "en", "s", 1), (None, None, "en", "s", 1), (7, long, "en", "t", 1), (8, long + " end", "en", "t", 1), (9, "²³ 😀 é and more words here", None, None, 1),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs = docs.select(*(F.lit(i).alias(c) for i, c in enumerate(CLASHES)), "*")
    stages = dict(corpus_pipeline.STAGES)

    def step(name, df):
        stages[name](spark, df, SF).write.parquet(path := str(tmp_path / f"{name}-{df.count()}"))
        out = spark.read.parquet(path)
        return out, Counter((r["doc_id"], r["text"]) for r in out.collect()) if "text" in out.columns else None

    given = Counter((r[0], r[1]) for r in rows)
    safe, found = step("toxicity", docs)
    assert safe.columns == docs.columns and found == given and {tuple(r)[: len(CLASHES)] for r in safe.collect()} == {tuple(range(len(CLASHES)))}
    one, found = step("exact dedup", safe)
    assert one.columns == docs.columns and found == Counter([(1, None), (3, rows[2][1]), (4, rows[3][1]), (None, rows[5][1]), (7, long), (8, long + " end"), (9, rows[9][1])])
    far, found = step("n-gram Jaccard join", one)
    assert far.columns == docs.columns and found == Counter([(1, None), (3, rows[2][1]), (4, rows[3][1]), (None, rows[5][1]), (7, long), (9, rows[9][1])])
    mixed, found = step("mixing", far)
    assert mixed.columns == docs.columns and set(found) <= {(4, rows[3][1]), (None, rows[5][1]), (7, long), (9, rows[9][1])} and found
    done = stages["byte-level BPE"](spark, mixed, SF)
    out = done.collect()
    assert done.columns == ["doc_id", "n_tokens", "ids", "position"] and sorted(r["position"] for r in out) == list(range(mixed.count()))
    assert Counter(r["doc_id"] for r in out) == Counter(k[0] for k in found.elements()) and all(len(r["ids"]) == r["n_tokens"] > 0 for r in out)


def test_stages_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    now = spark.createDataFrame([], SCHEMA)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, SF).write.parquet(path := str(tmp_path / str(k)))
        now = spark.read.parquet(path)
        assert now.count() == 0, name


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from wayfold.llm.store import shared_dir

    context = lambda master: SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None)
    session = lambda master, found=None: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: found), sparkContext=context(master))
    with pytest.raises(ValueError):
        shared_dir(session("spark://host:7077"))
    with pytest.raises(ValueError):
        shared_dir(session("local-cluster[3,2,1024]"))
    assert shared_dir(session("local[4]")) and shared_dir(session("yarn", "hdfs://x/shared/")) == "hdfs://x/shared"


def test_a_worker_keeps_nothing_after_its_task(monkeypatch):
    """Idle workers take turns, so what each keeps counts once for every worker of an executor."""
    trims, held = [], []
    monkeypatch.setattr(T, "trim", lambda: trims.append(len(held)))

    def run(batches):
        own = [1]
        held.append(own)
        yield from batches

    assert list(T.tidied(run)([1, 2])) == [1, 2] and trims == [1]
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["one two one"])], ["doc_id", "text"])
    ids = [ids.tolist() for _, ids, _ in byte_bpe._encoded(BPE, [batch, batch])]
    assert ids[0] == ids[1] == byte_bpe.encode_batch(BPE, pa.array(["one two one"]))[0].tolist()
    byte_bpe._state.clear()
    assert list(byte_bpe._encoded(BPE, [batch])) and not {BPE, ("cache", BPE)} & set(byte_bpe._state)
