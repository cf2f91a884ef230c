"""Filter audit, exponion clusters and WAV fingerprints against plain versions."""

import hashlib
import io
import itertools
import random
import re
import wave
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm import exponion as X, filter_audit as A, media as M

W = re.compile(r"[^\x20\x09-\x0D]+")


def plain_audit(rows, labels):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    cells = {}
    for i, t, _, source, *_ in rows:
        t = t or ""
        w = W.findall(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        good, toxic = (any(x[k] == 1 for x in labels if x[0] == i and i is not None) for k in (1, 2))
        cells.setdefault(source or "", []).append(({k for k, v in fails.items() if v}, good, toxic))
    out = {}
    for part, docs in cells.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = list(range(len(docs)))
            for k, c in enumerate(order):
                gone = [d for d in left if c in docs[d][0]]
                fail = [d for d in range(len(docs)) if c in docs[d][0]]
                left = [d for d in left if c not in docs[d][0]]
                shapley[c] += len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), len(fail) - len(gone), sum(docs[d][0] == {c} for d in fail), sum(docs[d][1] for d in gone), sum(docs[d][2] for d in gone), c]
        for key, v in out.items():
            if key[0] == part:
                v[-1] = shapley[v[-1]]
    return out


def audited(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def test_audit(spark, docs, rows, none):
    labels = [(i, i % 2, i % 3 == 0 and 1 or None) for i in range(0, 90, 2)] + [(4, 0, 1), (None, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    more = [(None, "shared text", "en", "a", 1), (None, "shared text", "en", "a", 1), (500, "shared text", "en", None, 1), (501, "THE $ end " * 40, "en", "b", 1)]
    all_ = docs.union(spark.createDataFrame(more, docs.schema))
    got = audited(A.filter_audit(all_, table))
    assert got == plain_audit(rows + more, labels) and len(got) == 600 * 5
    clash = all_.withColumnsRenamed({"lang": "part", "key": "mask"}).withColumn("digest", F.lit(1))
    assert audited(A.filter_audit(clash, table)) == got
    assert A.filter_audit(none, table).count() == 0
    assert audited(A.filter_audit(all_, table.limit(0))) == plain_audit(rows + more, [])


def test_audit_of_many_parts(spark, monkeypatch):
    """Parts are let go before the table's end, and come again."""
    monkeypatch.setattr(A, "PARTS", 3)
    monkeypatch.setattr(A, "ROWS", 2)
    rng = random.Random(1)
    rows = [(str(rng.randrange(9)), rng.randrange(32), rng.random() < 0.5, rng.random() < 0.2) for _ in range(200)]
    batch = spark.createDataFrame(rows, "part string, mask int, good boolean, toxic boolean").toArrow().combine_chunks().to_batches()[0]
    sums = {}
    for b in A.tally(iter([batch, batch])):
        for part, order, step, *n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            sums[part, order, step] = [x + y for x, y in zip(sums.get((part, order, step), [0, 0, 0]), n, strict=True)]
    for part, order in itertools.product(map(str, range(9)), range(0, 120, 17)):
        for step in range(6):
            own = [r for r in rows if r[0] == part and A.FIRST[r[1], order] == step]
            assert sums[part, order, step + 1] == [2 * len(own), 2 * sum(r[2] for r in own), 2 * sum(r[3] for r in own)]


def plain_clusters(vectors, k=8, rounds=10, seed=3, width=64):
    kept = [(i, [int(np.floor(1024 * np.float64(np.float32(x)))) for x in v]) for i, v in vectors if v is not None and len(v) == width and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    centroids = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((apart(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            group = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if group:
                centroids[j] = [sum(c) // len(group) for c in zip(*group, strict=True)]
    final = [(i, *near(v)) for i, v in kept]
    sums = [sum(d for _, d, c in final if c == j) for j in range(len(centroids))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, sums[c], sum(sums), names[c]) for i, d, c in final), key=str)


@pytest.mark.parametrize("kind", ["spread", "ties", "few"])
def test_clusters(spark, kind):
    rng = np.random.default_rng(3)
    n = {"spread": 300, "ties": 200, "few": 5}[kind]
    if kind == "ties":  # many equal distances, equal vectors and equal centroids
        x = np.zeros((n, 64))
        x[:, :2] = rng.integers(0, 4, (n, 2)) / 1024
    else:
        x = rng.normal(size=(n, 64)) / 8 + rng.integers(0, 6, (n, 1)) / 4
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]
    rows += [(None, rows[0][1]), rows[1], rows[1], (900, None), (901, [0.5] * 63), (902, [0.5] * 63 + [None]), (903, [0.5] * 63 + [float("nan")]), (904, [0.5] * 63 + [float("inf")])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).withColumns({"cluster": F.lit("x"), "sums": F.lit(1)})
    got, scanned = X.cluster(df)
    assert sorted(map(tuple, got.collect()), key=str) == plain_clusters(rows)
    if kind == "spread":
        assert scanned < 0.7 * 11 * 8 * 303


def test_clusters_of_nothing_and_of_large_components(spark):
    df = spark.createDataFrame([(1, [2.0**18] * 64)], "vec_id long, embedding array<double>")
    assert X.cluster(df.limit(0))[0].count() == 0 and X.cluster(df.where("vec_id > 1"))[0].columns[-1] == "centroid_sha256"
    with pytest.raises(Exception, match="can't hold"):
        X.cluster(df)
    far = [(1, [2.0**17] * 64), (2, [-(2.0**17)] * 64), (3, [2.0**17 - 1] * 64)]
    got = X.cluster(spark.createDataFrame(far, "vec_id long, embedding array<double>"), k=2)[0].collect()
    assert sorted(map(tuple, got), key=str) == plain_clusters(far, k=2)


def test_bounds_keep_ties():
    """Round after round as a full search would have it, on points of a small grid where most distances are tied."""
    rng = np.random.default_rng(5)
    for _ in range(60):
        x = rng.integers(0, 5, (40, 3)).astype(np.int32)
        at, before, own = rng.integers(0, 5, (6, 3)), None, None
        upper = lower = np.zeros(0)
        for _ in range(6):
            own, _, upper, lower, _ = X.assign(x, own, upper, lower, X.Centroids(at, before))
            full = ((x[:, None] - at) ** 2).sum(2)
            assert (own == full.argmin(1)).all() and (upper**2 >= full.min(1) * (1 - 1e-6)).all()
            before, at = at, np.clip(at + rng.integers(-1, 2, at.shape), 0, 5)


def plain_pairs(samples):
    n = max(-(-(len(samples) - M.FRAME) // M.HOP), 0) + 1
    top = []
    for t in range(n):
        frame = [float(samples[k]) - 128 if k < len(samples) else 0.0 for k in range(t * M.HOP, t * M.HOP + M.FRAME)]
        wave_ = np.array(frame, np.float32) * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(M.FRAME) / M.FRAME))
        turns = np.exp(-2j * np.pi * np.outer(np.arange(129), np.arange(M.FRAME)) / M.FRAME)
        level = np.rint(64 * np.log2(1 + np.abs(turns @ wave_) ** 2)).astype(int).tolist()
        top.append([max((level[f], -f) for f in range(a, b)) for a, b in zip(M.BANDS, M.BANDS[1:], strict=False)])
    found = []
    for t in range(n):
        for band in range(len(M.BANDS) - 1):
            v, f = top[t][band]
            if v > (top[t - 1][band][0] if t else 0) and v >= (top[t + 1][band][0] if t + 1 < n else 0):
                found.append((t, -f))
    out = []
    for t, f in found:
        out += [t << 24 | f << 16 | g << 8 | (u - t) for u, g in [p for p in found if p[0] > t][: M.FAN] if u - t <= M.REACH]
    return sorted(out)


def test_media(spark, docs, rows, none):
    table = M.wav_column(docs.withColumnRenamed("lang", "media").withColumn("pairs", F.lit(2)))
    assert table.columns == ["doc_id", "n_bytes", "media"]
    stored = {r.doc_id: bytes(r.media) for r in table.collect()}
    got = M.with_feature(M.read_media(table)).collect()
    assert len(got) == len(rows)
    text = {i: (t or "").encode() for i, t, *_ in rows}
    for r in got:
        payload = text[r.doc_id] + bytes(-len(text[r.doc_id]) % 64 if text[r.doc_id] else 64)
        with wave.open(io.BytesIO(stored[r.doc_id])) as w:
            assert w.getsampwidth() == 1 and w.readframes(w.getnframes()) == payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text[r.doc_id]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored[r.doc_id]), hashlib.sha256(stored[r.doc_id]).hexdigest())
        assert r.feature == f"{len(r.pairs)}:{hashlib.sha256(','.join(map(str, r.pairs)).encode()).hexdigest()}"
        if r.doc_id % 7 == 0 or len(payload) < 200:
            assert r.pairs == plain_pairs(payload)
    assert {r.feature for r in got if text[r.doc_id] == b""} == {r.feature for r in got if r.n_bytes == 0}
    assert M.read_media(M.wav_column(none)).count() == 0


def test_fingerprint_of_long_sounds_and_tones(monkeypatch):
    rng = random.Random(2)
    long = bytes(rng.choice(b"etaoin shrdlu,.") for _ in range(20000))
    want = plain_pairs(long)
    assert M.fingerprint(np.frombuffer(long, np.uint8)).tolist() == want and len(want) > 500
    monkeypatch.setattr(M, "FRAMES", 7)  # blocks of frames change nothing
    assert M.fingerprint(np.frombuffer(long, np.uint8)).tolist() == want
    # a tone of bin 40 in the middle of silence is a peak there
    tone = np.full(8192, 128, np.uint8)
    tone[2048:3072] = 128 + 90 * np.sin(2 * np.pi * 40 * np.arange(1024) / 256)
    frames, bins = M.peaks(tone)
    assert 40 in bins and all(13 <= t <= 24 for t in frames)
