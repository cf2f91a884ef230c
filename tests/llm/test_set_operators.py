"""Dedup, mixing, token files, similarity join, packing and the pipeline against plain versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmark.llm import common, exact_dedup as D, mixing as M, near_join as N, packing as P, tokens as T

LOWER = str.maketrans(common.UPPER, common.LOWER)
W = re.compile(r"[^\x20\x09-\x0D]+")
BYTE, WORD = T.tokenizer_path("byte_bpe_50k.json"), T.tokenizer_path("word_bpe_49k.json")


@pytest.mark.parametrize("how", [{}, {"key_bits": 3, "bucket_entries": 2}])
def test_exact_dedup(docs, rows, how):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[(t or "").translate(LOWER)].append(i)
    got = D.extendible_dedup(docs, **how).collect()
    assert len(got) == len(rows)
    text = {i: (t or "").translate(LOWER) for i, t, *_ in rows}
    for r in got:
        own = groups[text[r.doc_id]]
        assert (r.keep_id, r.group_size) == (max(own), len(own)) and r.text_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)


def test_directory_splits_overfull_buckets(spark):
    # 4-bit keys, 2 to a bucket: 0000 0001 | 0010 | 01.. | 1...
    keys = spark.createDataFrame([(k,) for k in (0, 1, 2, 3, 4, 15, 8)], "key long")
    found, depth = D.directory(keys, 2, 4)
    assert depth == 3 and {r.slot: (r.local_depth, r.bucket) for r in found.collect()} == {0: (3, 0), 1: (3, 1), 2: (2, 2), 4: (1, 4), 7: (1, 4)}
    index, _, _ = D.build_index(keys.union(keys.where("key = 3")), 2, 4)
    assert {(r.bucket, r.key): r.rows for r in index.collect()} == {(0, 0): 1, (0, 1): 1, (1, 2): 1, (1, 3): 2, (2, 4): 1, (4, 15): 1, (4, 8): 1}
    deep, depth = D.directory(keys, 1, 4)
    assert depth == 4 and deep.count() == 7


def test_hot_keys_join_as_others(spark, monkeypatch):
    monkeypatch.setattr(common, "WARM", 0)
    left = spark.createDataFrame([(k % 7, k) for k in range(50)], "k int, v int")
    right = left.where("k < 6").groupBy("k").count()
    for total in (50, 50 << 14, 7 << 14):
        for how in ("inner", "left"):
            want = sorted(map(tuple, left.join(right, ["k"], how).fillna(-1).collect()))
            assert sorted(map(tuple, common.join_hot(left, right, ["k"], "count", total, how).fillna(-1).collect())) == want


def test_survivors(docs, rows, none):
    out = D.survivors(docs)
    assert out.columns == docs.columns and out.count() == len({(t or "").translate(LOWER) for _, t, *_ in rows})
    assert D.survivors(none).count() == 0 and D.extendible_dedup(none).count() == 0


def fill(sizes, weights, most=3.0):
    left, free, target = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while free and left > 1e-9:
        w = sum(weights[k] for k in free)
        share = {k: left * weights[k] / w for k in free}
        over = {k for k in free if share[k] > most * sizes[k]}
        if not over:
            for k in free:
                target[k] = share[k]
            break
        for k in over:
            target[k] = most * sizes[k]
            left -= target[k]
        free -= over
    return target


def test_mix(docs, rows, none):
    size = lambda t: len(W.findall(t or ""))
    by = Counter()
    for _, t, _, s, _ in rows:
        by[s] += size(t)
    names = sorted((s for s in by if s is not None)) + [None]
    target = dict(zip(names, fill([by[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))])))
    got = M.mix(docs).collect()
    assert len(got) == len(rows)
    source = {i: (size(t), s) for i, t, _, s, _ in rows}
    taken = Counter()
    for r in got:
        n, s = source[r.doc_id]
        assert (r.size, r.source_size) == (n, by[s]) and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 3 * n
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    for r in got:
        assert r.positions == sorted(r.positions) and (not r.positions or 0 < r.positions[0] and r.positions[-1] < 1) and bool(r.positions) == (r.taken > 0)
    assert [r.positions[:1] for r in got] == sorted(r.positions[:1] for r in got)
    key = lambda r: (r.doc_id, r.taken, r.positions)
    assert sorted(map(key, got)) == sorted(map(key, M.mix(docs.repartition(7)).collect()))
    assert M.mix(none).count() == 0


def test_mixed_documents(docs, rows):
    out = M.mixed_documents(docs)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r.doc_id] += len(W.findall(r.text))
    want = Counter()
    for r in M.mix(docs).collect():
        want[r.doc_id] += r.taken
    assert +words == +want


def test_mixed_documents_of_repeated_rows(spark):
    rows = [(1, "a b c", "x", 1), (1, "a b c", "x", 1), (1, "a b c", "x", 2), (2, "d e", "y", 3), (3, "f " * 40, "z", 4)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, other long")
    out, taken = Counter(), Counter()
    for r in M.mixed_documents(d).collect():
        out[r.doc_id, r.other] += len(r.text.split())
    for r in M.mix(d).collect():
        taken[r.doc_id] += r.taken
    assert out[1, 1] + out[1, 2] == taken[1] == 27 and out[1, 1] == 18 and taken[3] == out[3, 4]


@pytest.mark.parametrize("knots", [((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.0), (0.5, 2.0), (1.0, 0.0)), ((0.0, 1.0), (0.3, 1.0), (1.0, 5.0))])
def test_inverted_schedule(spark, knots):
    q = [k / 50 for k in range(51)]
    got = [r.t for r in spark.createDataFrame([(x,) for x in q], "q double").select("q", M.invert(F.col("q"), knots).alias("t")).orderBy("q").collect()]
    grid = np.linspace(0, 1, 200001)
    w = np.interp(grid, [k for k, _ in knots], [v for _, v in knots])
    cum = np.concatenate(([0], np.cumsum((w[1:] + w[:-1]) / 2)))
    assert got == sorted(got) and np.interp(got, grid, cum / cum[-1]) == pytest.approx(q, abs=1e-4)


def direct(path, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_is_exact(rows, path):
    import random

    rng = random.Random(1)
    alphabet = "ab Z9 0'''stremvld.,!?\n\t\r é\x85\xa0　\x1c\x7f<|endoftext|>ßİ日#$_-"
    texts = [t or "" for _, t, *_ in rows] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    texts += ["".join(rng.choice(" \n\t a,.\x1c") for _ in range(rng.randint(0, 9))) for _ in range(4000)]
    enc = T.Encoder.of(path)
    assert [np.frombuffer(b, enc.dtype).tolist() for b in enc.encode(texts)] == direct(path, texts)


def test_token_files(spark, docs, rows, none):
    path = common.new_path(spark, "t")
    made = T.write_tokens(docs, path, BYTE, 2)
    got = sorted(T.read_tokens(spark, path, made).collect(), key=lambda r: r.start)
    order = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    at = 0
    for r, (i, _, *_), ids in zip(got, order, direct(BYTE, [t or "" for _, t, *_ in order]), strict=True):
        ids = [*ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    again = T.write_tokens(docs, path, BYTE, 2)
    assert again == made
    assert T.read_tokens(spark, path, T.write_tokens(none, common.new_path(spark, "t"), BYTE, 2)).count() == 0


def test_token_files_of_odd_ids(spark):
    rows = [(-1, "a"), (None, "b"), (-1, "c"), (0, None), (None, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    path = common.new_path(spark, "t")
    got = T.read_tokens(spark, path, T.write_tokens(d, path, BYTE, 2)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, -1, -1, 0] and sorted(r.n_tokens for r in got) == [1, 1, 2, 2, 2]


def shingle_set(t):
    w = W.findall((t or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])


def plain_groups(rows):
    sets = {i: shingle_set(t) for i, t, *_ in rows}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 90 * len(x | y):
                p, q = top(a), top(b)
                up[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.mark.parametrize("how", [{}, {"tile": 3, "hub_rounds": 1}])
def test_near_groups(docs, rows, how):
    want = plain_groups(rows)
    got = N.near_groups(docs, **how).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len({c for _, c in want.values()}) < len(want) - 10


def test_near_groups_empty(none):
    assert N.near_groups(none).count() == 0


def test_tree_bounds_lose_nothing():
    rng = np.random.default_rng(0)
    base = [rng.choice(100000, rng.integers(20, 400), replace=False) for _ in range(40)]
    sets = [set(b.tolist()) for b in base] + [set(b.tolist()) - set(b[: len(b) // 25].tolist()) for b in base for _ in range(2)]
    size = np.array([len(s) for s in sets])
    point = np.array([np.bincount(np.array(sorted(s)) * 7919 % N.FOLDED, minlength=N.FOLDED) for s in sets])
    got = {(min(i, j), max(i, j)) for a, b in N.tree_join(size, point, 90, 100) for i, j in zip(a.tolist(), b.tolist())}
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])}
    assert want <= got and len(want) >= 80 and len(got) < len(sets) ** 2 / 8


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(100, 101)], "a long, b long")
    assert Counter(r.comp for r in N.components(links).collect()) == {0: 31, 100: 2}


def test_packing(docs, rows, none):
    got = P.pack_documents(docs, WORD, 2, window=256, shard_tokens=4000).collect()
    ids = defaultdict(list)
    for (i, t, *_), x in zip(rows, direct(WORD, [t or "" for _, t, *_ in rows]), strict=True):
        ids[i].append([*x, 2])
    spread = defaultdict(list)
    for r in got:
        spread[r.doc_id].append(r)
    assert set(spread) == set(ids)
    for i, pieces in spread.items():
        x, copies = ids[i][0], len(ids[i])
        assert sum(p.length for p in pieces) == copies * len(x)
        for p in pieces:
            assert p.doc_tokens == len(x) and p.ids_crc32 == zlib.crc32(np.array(x[p.start : p.start + p.length], "<u4").tobytes())
        if copies == 1:
            at = 0
            for p in sorted(pieces, key=lambda p: p.start):
                assert p.start == at
                at += p.length
    windows = defaultdict(list)
    for r in got:
        windows[r.sequence_id].append(r)
    short = 0
    for pieces in windows.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= 256
        short += at < 256
    assert short <= len({s >> 32 for s in windows}) + sum(r.length for r in got) // 4000
    # long documents of one route make several shards of a task
    again = P.pack_documents(docs, WORD, 2, window=256, shard_tokens=300).collect()
    assert sum(r.length for r in again) == sum(r.length for r in got) and len({(r.sequence_id, r.offset) for r in again}) == len(again)
    assert sorted(map(tuple, again)) == sorted(map(tuple, P.pack_documents(docs, WORD, 2, window=256, shard_tokens=300).collect()))
    assert P.pack_documents(none, WORD, 2).count() == 0


def test_bm25_neighbours_are_lexical():
    docs = [np.array(x, np.uint16) for x in ([5, 5, 6, 2], [9, 9, 8, 2], [5, 6, 7, 2], [8, 9, 9, 2])]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=16)
    index = P.Index(docs, P.idf(df, 4), 4.0)
    index.unused[0] = False
    assert next(index.neighbours(0)) == 2
    index.unused[2] = False
    assert 2 not in list(index.neighbours(0))


@pytest.mark.parametrize("n,common", [(30, 16), (300, 16), (300, 10**9), (300, 1)])
def test_neighbours_by_all_terms(monkeypatch, n, common):
    monkeypatch.setattr(P, "COMMON", common)
    rng = np.random.default_rng(2)
    docs = [rng.choice(np.concatenate((np.arange(1, 400), np.arange(1, 40))), rng.integers(1, 90)).astype(np.uint16) for _ in range(n)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=400)
    weight, mean = P.idf(df, n), 45.0
    index = P.Index(docs, weight, mean)
    tf = [Counter(d.tolist()) for d in docs]
    bm = lambda t, e: float(weight[t]) * tf[e][t] * (P.K1 + 1) / (tf[e][t] + P.K1 * (1 - P.B + P.B * len(docs[e]) / mean))
    for d in range(25):
        index.unused[d] = False
        score = {e: sum(bm(t, e) for t in tf[d] if t in tf[e]) for e in range(d + 1, n)}
        got = list(index.neighbours(d))
        assert sorted(got) == sorted(e for e in score if score[e] > 0) and [score[e] for e in got] == pytest.approx(sorted((x for x in score.values() if x > 0), reverse=True), rel=1e-5)


def test_pipeline(spark, tmp_path, rows, docs):
    import corpus_pipeline as C

    docs.drop("key").withColumn("n_chars", F.length("text").cast("long")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], 1, 0) for r in rows[::3]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in C.STAGES] == ["toxicity", "exact_dedup", "near_join", "mixing", "packing"]
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    cols, groups = d.columns, plain_groups(rows)
    for k, (name, stage) in enumerate(C.STAGES):
        d = common.staged(stage(spark, d, str(tmp_path)), name)
        if k < 4:
            assert d.columns == cols
        if name == "near_join":
            assert sorted(groups[r.doc_id][1] for r in d.collect() if groups[r.doc_id][0]) == sorted({g for n, g in groups.values() if n})
    assert d.count() == C.run(spark, str(tmp_path)).count() > 0


def test_chunks_of_long_texts():
    from quillmark.llm import words

    texts = ["a b " * 400000, None, "", "c"]
    spans = list(words.chunks(pa.array(texts)))
    assert sum(len(off) - 1 for _, _, off in spans) == 4 and len(words.Words(*spans[0][1:]).start) == 800000


def test_pipeline_drops_near_copies_of_five_words(spark):
    import corpus_pipeline as C

    w = [f"w{k}" for k in range(64)]
    # one word changed: 55 of 65 five-word shingles are shared (0.846), 59 of 65 (0.908) of three; two words: 3 words give 56 of 68 (0.824)
    near, far = w[:30] + ["x"] + w[31:], w[:30] + ["x"] + w[31:50] + ["y"] + w[51:]
    short = [f"v{k}" for k in range(55)]  # 46 of 56 (0.821) of five words, 50 of 56 (0.893) of three
    texts = [w, near, far, short, short[:30] + ["x"] + short[31:]]
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    linked = {b for a in range(5) for b in range(a + 1, 5) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert linked == {1, 2, 4} and sorted(r.doc_id for r in C.drop_near_copies(spark, d, "").collect()) == [0, 3]


def thue_morse(n, flip=False):
    return "".join("ab"[(bin(k).count("1") + flip) % 2] for k in range(n))


def test_words_are_told_apart(spark):
    head = " ".join(f"w{k}" for k in range(4))
    d = spark.createDataFrame([(1, f"{head} {thue_morse(1024)}"), (2, f"{head} {thue_morse(1024, True)}")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in N.near_groups(d).collect()} == {1: 1, 2: 2}


def test_near_groups_of_repeated_ids(spark):
    t, u, v = (" ".join(f"{c}{k}" for k in range(30)) for c in "tuv")
    d = spark.createDataFrame([(1, t), (5, t), (5, u), (9, u), (9, None), (None, t), (7, v)], "doc_id long, text string")
    got = sorted(((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in N.near_groups(d).collect()))
    assert got == [(-1, 28, -1), (1, 28, 1), (5, 28, 1), (5, 28, 1), (7, 28, 7), (9, 0, 1), (9, 28, 1)]


def test_clipped_counts_bound_nothing():
    size = np.array([9_000_000, 9_000_100])
    p = np.full((2, N.GROUPS), 65535, np.uint16)
    opened = N._open(p, size, 65535)
    assert N.may_link(size[0], size[1], np.minimum(opened[0], opened[1]).sum(dtype=np.int64), 90, 100)


def test_a_new_owner_gets_the_memory_of_the_last_ones_cache():
    """In a process of its own: blocks below one that is still used go back to the system once another cache is claimed."""
    import subprocess
    import sys

    code = """
import os
from quillmark.llm import caches
size = lambda: int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20
held = []
caches.claim("one", held.clear)
held += [bytes(2000) for _ in range(100_000)]
last, full = bytes(2000), size()
caches.claim("two", lambda: None)
assert size() < full - 100, (full, size())
"""
    subprocess.run([sys.executable, "-c", code], check=True)
