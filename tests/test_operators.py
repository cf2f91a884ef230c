"""Segments, entities, reports, models, annotators, audio, sources and plans."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.operators import annotate as A, audio, entities as E, models, report as R, segments as S
from quillmark.functions import text as T
from quillmark.plans import repair as P
from quillmark.sources import io


def test_speaker_segments(spark):
    texts = ["lead\nss: x\nmore", "ss: Hi\nps: A: b", "", "none"]
    want = [[("ss", "x more")], [("ss", "Hi"), ("ps", "A: b")], [], []]
    d = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = d.select("k", S.speaker_segments(F.col("t")).alias("s")).orderBy("k").collect()
    assert [[tuple(x) for x in r.s] for r in got] == want
    rows = S.speaker_segment_rows(d, "k", "t").orderBy("k", "pos").collect()
    assert [(r.k, r.speaker, r.text) for r in rows] == [(k, *x) for k, w in enumerate(want) for x in w]


def test_speaker_accuracy(spark):
    d = spark.createDataFrame([("A: x\nB: y", "a: x\nC: y\nD: z"), ("x", "A: x")], "r string, h string")
    got = d.select(S.speaker_accuracy(S.speaker_segments(F.col("r")), S.speaker_segments(F.col("h"))).alias("x")).collect()
    assert [r.x for r in got] == [0.5, 0.0]


def test_entities(spark):
    d = spark.createDataFrame([(1, "I bought HDFC Bank in Mumbai. General Public", "i bought hdfc, general publik"), (2, "x", "y")], "k int, r string, h string")
    more = E.gazetteer(spark).union(spark.createDataFrame([("HDFC Bank", "ORG"), ("general publik", "PERSON")], "name string, category string"))
    ref, hyp = E.entities(d, "k", "r", more), E.entities(d, "k", "h", more)
    assert sorted(map(tuple, ref.collect())) == [(1, "LOCATION", "mumbai"), (1, "ORG", "hdfc bank"), (1, "PERSON", "general public")]
    rows = {(r.k, r.category): (r.n_ref, r.n_matched, r.score) for r in E.entity_rows(d, "k", ref, hyp, E.aliases(spark)).collect()}
    assert rows[1, "ORG"] == (1, 1, 1.0) and rows[1, "LOCATION"] == (1, 0, 0.0) and rows[1, "PERSON"] == (1, 1, 1.0) and rows[2, "ORG"] == (0, 0, 1.0) and len(rows) == 10
    scores = E.entity_scores(E.entity_rows(d, "k", ref, hyp, E.aliases(spark)), "k").collect()
    assert {r.k: r.entity for r in scores} == {1: pytest.approx(2 / 3), 2: 1.0}
    z = spark.createDataFrame([(1, {"ORG": ["A  b"], "NEW": ["b"]})], "k int, m map<string,array<string>>")
    filled = z.select(E.with_defaults(F.col("m")).alias("m")).first()
    assert set(filled.m) == set(E.CATEGORIES) | {"NEW"} and filled.m["ORG"] == ["A  b"]
    assert sorted(map(tuple, E.from_maps(z, "k", "m").collect())) == [(1, "NEW", "b"), (1, "ORG", "a b")]


def test_rerank_is_stable(spark):
    d = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.5), (1, 2, None), (1, 3, 0.9)], "g int, pos int, s double")
    assert [r.pos for r in R.rerank(d, ["g"], "s", "pos").orderBy("rank").collect()] == [3, 0, 1, 2]


def test_calibration(spark):
    rng = np.random.default_rng(1)
    c, y = rng.integers(0, 20, 300) / 20, rng.integers(0, 2, 300)
    d = spark.createDataFrame([(float(a), int(b), int(a >= 0.6)) for a, b in zip(c, y)], "c double, y int, p int")
    m = R.calibration(d, "p", "y", "c").first()
    pos, neg = c[y == 1], c[y == 0]
    assert m.auroc == pytest.approx(((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg)))
    assert m.accuracy == pytest.approx(((c >= 0.6) == y).mean()) and m.brier == pytest.approx(((c - y) ** 2).mean())


def test_buckets_keep_zeros(spark):
    d = spark.createDataFrame([(0.9,), (0.1,)], "s double")
    assert {r.bucket: (r.n, r.percent) for r in R.score_buckets(d, "s").collect()} == {"excellent": (1, 50.0), "good": (0, 0.0), "fair": (0, 0.0), "poor": (1, 50.0)}


def test_models(spark, tmp_path):
    d = spark.createDataFrame([(float(i), float(i % 7), float(i > 20)) for i in range(40)], "a double, b double, y double")
    m = models.fit(d, ["a", "b"], "y")
    assert models.importance(spark, m).first().feature == "a"
    models.save(m, str(tmp_path / "m"))
    assert models.predict(d, models.load(str(tmp_path / "m"))).count() == 40
    assert all(x >= 0 for x in models.cross_validated(d, ["a", "b"], "y", folds=2))
    with pytest.raises(ValueError):
        models.fit(d.limit(3), ["a"], "y")


def test_annotators(spark):
    d = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "t string")
    got = A.annotate(d, "t", A.LocalRules(F.upper)).collect()
    assert sorted((r.t or "", r.annotation or "") for r in got) == [("", ""), ("x", "X"), ("x", "X"), ("y", "Y")]

    def call(x):
        if x == "y":
            raise RuntimeError
        return x + "!"

    got = A.annotate(d, "t", A.Remote(call, back_off=0.0)).collect()
    assert sorted((r.t or "", r.annotation or "") for r in got) == [("", ""), ("x", "x!"), ("x", "x!"), ("y", "")]
    def slow(x):
        import time

        time.sleep(5 if x == "x" else 0)
        return x

    got = A.annotate(d, "t", A.Remote(slow, tries=1, timeout=0.5)).collect()
    assert sorted((r.t or "", r.annotation or "") for r in got) == [("", ""), ("x", ""), ("x", ""), ("y", "y")]
    ready = spark.createDataFrame([("x", "1")], "text string, annotation string")
    assert {r.annotation for r in A.annotate(d, "t", A.Precomputed(ready)).collect()} == {"1", None}


def test_repair_passes_failed_chunks(spark):
    text = " ".join(f"w{i}" for i in range(400))
    d = spark.createDataFrame([(1, text), (2, ""), (3, None)], "k int, t string")
    got = {r.k: r.repaired for r in P.repair(d, "k", "t", A.LocalRules(lambda c: F.when(F.startswith(c, F.lit("w0 ")), F.upper(c)))).collect()}
    assert len(got[1].split()) == 400 + 20 * 2 and got[1].startswith("W0 ") and got[2] == got[3] == ""
    assert P.repair(d, "k", "t", A.LocalRules(F.lower), dedup_overlap=True).where("k = 1").first().repaired == text
    assert P.translate(d, "k", "t", A.LocalRules(F.lower)).where("k = 1").first().translated == text


def tone(hz, seconds=1.0, rate=16000, level=0.5):
    return level * np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate)


def loudest(x, rate=16000):
    return np.argmax(np.abs(np.fft.rfft(x * np.hanning(len(x))))) * rate / len(x)


def test_augmentation():
    x, rng = tone(440), np.random.default_rng(0)
    assert np.abs(audio.decode_wav(audio.encode_wav(x))[0] - x).max() < 1e-3
    mixed = audio.background_noise(x, np.ones(10) * 0.1, 20, rng) - x
    assert 10 * np.log10((x**2).mean() / (mixed**2).mean()) == pytest.approx(20)
    assert (audio.augment(x, audio.Augmentation()) == audio.augment(x, audio.Augmentation())).all()
    assert np.abs(audio.reverb(x, rng)).max() == pytest.approx(1) and not audio.reverb(np.zeros(10), rng).any()
    # a stretch keeps the pitch, a shift keeps the length
    for steps in (12, 3, -5):
        y = audio.pitch_shift(x, steps)
        assert len(y) == len(x) and loudest(y) == pytest.approx(440 * 2 ** (steps / 12), rel=0.01)
    for rate in (0.8, 1.25):
        y = audio.time_stretch(x, rate)
        assert len(y) == round(len(x) / rate) and loudest(y) == pytest.approx(440, rel=0.01)
    assert len(audio.pitch_shift(np.zeros(0), 2)) == len(audio.time_stretch(np.zeros(0), 2)) == 0
    only = audio.Augmentation(kind="volume", volume=0.5, white_noise=True)
    assert np.allclose(audio.augment(x, only), x * 0.5)
    assert np.abs(audio.augment(x * 9, audio.Augmentation(kind="volume"))).max() == 1


def test_resampling():
    x = tone(440, rate=8000)
    y = audio.resample(x, 8000, 16000)
    assert len(y) == 16000 and loudest(y) == 440 and np.abs(audio.resample(y, 16000, 8000) - x).max() < 1e-9
    # what the lower rate can't hold is gone
    assert np.abs(audio.resample(tone(6000), 16000, 8000)).max() < 1e-6
    assert loudest(audio.load(audio.encode_wav(x, 8000))) == 440


def test_wav_widths():
    import io as bytes_io
    import wave

    for width, raw in ((1, bytes([128, 255, 0])), (2, np.array([0, 32767, -32768], "<i2").tobytes()), (3, b"\0\0\0\xff\xff\x7f\0\0\x80"), (4, np.array([0, 2**31 - 1, -(2**31)], "<i4").tobytes())):
        out = bytes_io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(width)
            w.setframerate(8000)
            w.writeframes(raw)
        x, rate = audio.decode_wav(out.getvalue())
        assert rate == 8000 and x == pytest.approx([0, 1, -1], abs=0.01)


def test_features_of_known_sounds():
    s = audio.clip_stats(tone(220))
    assert s["f0_mean"] == pytest.approx(220, rel=0.01) and s["f0_std"] < 2 and s["voiced_ratio"] > 0.9 and s["pause_ratio"] == 0 and s["energy_mean"] == pytest.approx(0.35, abs=0.02)
    assert s["spectral_centroid_mean"] == pytest.approx(220, rel=0.1) and s["zero_crossing_rate_mean"] == pytest.approx(440 / 16000, rel=0.05)
    rising = np.sin(np.cumsum(2 * np.pi * np.linspace(150, 300, 32000) / 16000)) * 0.5
    r = audio.clip_stats(rising)
    assert r["f0_slope"] > 1 and r["f0_range"] == pytest.approx(150, abs=25) and r["f0_median"] == pytest.approx(225, abs=10)
    beats = np.zeros(16000 * 5)
    for k in range(10):  # two a second
        beats[k * 8000 : k * 8000 + 1500] = tone(300, 1500 / 16000) * np.exp(-np.arange(1500) / 300)
    b = audio.clip_stats(beats)
    assert b["tempo"] == pytest.approx(120, rel=0.06) and b["speaking_rate"] == pytest.approx(2, abs=0.5) and b["rhythm_regularity"] > 0.8 and b["pause_ratio"] > 0.3
    assert set(s) == set(audio.PROSODY) | set(audio.FLUENCY) and len(s) == 22
    assert not any(audio.clip_stats(np.zeros(0)).values()) and not any(audio.clip_stats(np.zeros(9000))[k] for k in audio.PROSODY)
    noise = audio.clip_stats(np.random.default_rng(1).standard_normal(16000) * 0.1)
    assert noise["voiced_ratio"] < 0.1 and noise["zero_crossing_rate_mean"] in (0.0, pytest.approx(0.5, abs=0.05))


def test_audio(spark, tmp_path):
    (tmp_path / "sample_1.wav").write_bytes(audio.encode_wav(np.zeros(8000)))
    (tmp_path / "sample_2.wav").write_bytes(b"bad")
    (tmp_path / "sample_3.wav").write_bytes(audio.encode_wav(tone(440, rate=8000), 8000))
    got = {r.path[-5]: r.f0_mean for r in audio.clip_features(spark, str(tmp_path)).collect()}
    assert got == {"1": 0.0, "2": 0.0, "3": pytest.approx(440, rel=0.01)}
    ids = spark.createDataFrame([(1,), (9,)], "sample_id long")
    assert {r.sample_id: bool(r.audio_path) for r in io.audio_files(spark, ids, str(tmp_path)).collect()} == {1: True, 9: False}
    made = audio.augmented(audio.wav_files(spark, str(tmp_path)), 7)
    rows = made.collect()
    assert len(rows) == 14 and {r.variant for r in rows} == set(range(7)) and all(audio.decode_wav(r.content)[1] in (8000, 16000) for r in rows)
    assert {(r.name, r.content) for r in rows} == {(r.name, r.content) for r in made.collect()}
    files = audio.write_clips(made, f"file://{tmp_path}/out").collect()
    assert sorted(f.path.split("/")[-1] for f in files) == sorted(r.name for r in rows) == sorted(p.name for p in (tmp_path / "out").iterdir())


def test_stt(spark):
    from quillmark.operators import stt

    clips = spark.createDataFrame([("a.wav",), ("b.wav",), ("c.wav",)], "audio_path string")
    table = spark.createDataFrame([("a.wav", '{"transcript":"x"}', "hi"), ("a.wav", '{"transcript":"y"}', "en"), ("b.wav", '{"segments":[{"text":"p"},{"text":"q"}]}', "hi")], "audio_path string, reply string, language string")
    got = stt.transcribe_batch(clips, stt.PrecomputedReplies(table)).orderBy("audio_path", "pos").collect()
    assert [(r.audio_path, r.transcript) for r in got] == [("a.wav", "x"), ("b.wav", "p"), ("b.wav", "q")]

    def call(path, language):
        if path == "b.wav":
            raise RuntimeError
        return f'{{"transcript":"{path} {language}"}}'

    got = {r.audio_path: (r.reply, r.backend) for r in stt.transcribe(clips, stt.RemoteReplies(call), "en").collect()}
    assert got == {"a.wav": ('{"transcript":"a.wav en"}', "remote"), "b.wav": (None, "remote"), "c.wav": ('{"transcript":"c.wav en"}', "remote")}
    cut = spark.createDataFrame([("a", audio.encode_wav(tone(440)), 0.25, 0.5), ("b", b"bad", 0.0, 1.0)], "audio_path string, content binary, start_ts double, end_ts double")
    assert {r.audio_path: r.content and len(audio.decode_wav(bytes(r.content))[0]) for r in stt.slices(cut).collect()} == {"a": 4000, "b": None}


def test_sources(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps([{"audio_path": "a", "reference_text": "x"}]))
    r = io.ground_truth(spark, str(tmp_path / "g.json")).first()
    assert (r.is_augmented, r.original_audio) == (False, "a")
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "1.json").write_text('{"segments":[{"text":"a"},{"text":"b"}]}')
    (tmp_path / "out" / "x.txt").write_text("no")
    assert [s.transcript for s in io.stt_outputs(spark, str(tmp_path / "out")).orderBy("file", "pos").collect()] == ["a", "b"]
    (tmp_path / "out" / "2.json").write_text('{\n "transcript": "over\\nlines"\n}')
    (tmp_path / "refs").mkdir()
    (tmp_path / "refs" / "2.txt").write_text(" over\nlines \n")
    (tmp_path / "refs" / "9.txt").write_text("alone")
    r = io.training_samples(io.stt_with_reference(io.named_files(spark, str(tmp_path / "out"), "*.json"), io.named_files(spark, str(tmp_path / "refs")))).collect()
    assert [(x.transcript, x.reference, x.quality_score) for x in r] == [("over\nlines", "over\nlines", 5)]
    io.write_array(spark.createDataFrame([(i, "é\n\"") for i in range(5)], "i int, t string").repartition(2), str(tmp_path / "array"))
    assert sorted(x["i"] for f in (tmp_path / "array").glob("part-*") for x in json.loads(f.read_text())) == [0, 1, 2, 3, 4]
    rows = spark.createDataFrame([(k % 2, 1, k / 10) for k in range(7)], "prediction int, label int, confidence double")
    io.write_calibration(rows, str(tmp_path / "cal"), rows=2)
    assert sorted(map(tuple, io.calibration_pairs(spark, str(tmp_path / "cal"), lines=True).collect())) == sorted(map(tuple, rows.collect()))
    (tmp_path / "c.json").write_text(json.dumps({"predictions": [1, 0], "labels": [1, 1], "confidences": [0.9, 0.2]}))
    assert io.calibration_pairs(spark, str(tmp_path / "c.json")).count() == 2
    io.write_results(io.ladder(spark, str(tmp_path / "g.json")), str(tmp_path / "w"))
    io.write_text(spark.createDataFrame([("a",), ("",)], "t string"), "t", str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).count() == 1


def test_ladder_errors_rise(spark):
    d = spark.createDataFrame([(" ".join(f"w{i}" for i in range(50)),)], "t string").select(T.tokens("t").alias("w"))
    n = [d.select(F.size(T.corrupted("w", *k)).alias("n")).first().n for k in ((10**6, 10**6, 10**6), (7, 10**6, 10**6))]
    assert n == [50, 44]  # one word is doubled by any rule


def plain_alignment(r, h):
    """(distance, hits) by the full table: least cost, then most hits."""
    row = [(j, 0) for j in range(len(h) + 1)]
    for i, x in enumerate(r, 1):
        new = [(i, 0)]
        for j, y in enumerate(h, 1):
            new.append(min((row[j][0] + 1, row[j][1]), (new[-1][0] + 1, new[-1][1]), (row[j - 1][0] + (x != y), row[j - 1][1] - (x == y))))
        row = new
    return row[-1][0], -row[-1][1]


def test_aligned_queries_see_whole_texts(spark, tmp_path):
    from quillmark import queries as Q

    texts = [" ".join(f"w{k * k % 41}" for k in range(n)) for n in (0, 1, 29, 31, 90, 400)]
    d = spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    d.write.parquet(str(tmp_path / "documents.parquet"))

    def corrupted(w):
        return ["[noise]" if i % 11 == 5 else x for i, x in enumerate(w) if i % 7 != 3]

    pairs = {i: (t.split(), corrupted(t.split())) for i, t in enumerate(texts)}
    want = {i: plain_alignment(*p) for i, p in pairs.items()}
    assert {r.doc_id: (r.distance, r.hits) for r in Q.mer_wil(spark, str(tmp_path)).collect()} == want
    assert {r.doc_id: r.word_count for r in Q.rerank_features(spark, str(tmp_path)).collect()} == {i: len(h) for i, (_, h) in pairs.items()}
    for r in Q.heuristic_quality(spark, str(tmp_path)).where("doc_id > 0").collect():
        (x, h), (d, k) = pairs[r.doc_id], want[r.doc_id]
        n, m = len(x), len(h)
        rates = [d / n, d / (d + k), 1 - k / n * (k / m)]
        assert r.quality_score == pytest.approx(sum(max(0, 1 - v) * w for v, w in zip(rates, (0.4, 0.3, 0.2))) + max(0, 1 - abs(m / n - 1)) * 0.1, abs=1e-5)


def test_gbt_query_fits_all_rounds(spark, monkeypatch):
    from quillmark import queries as Q

    d = spark.createDataFrame([(i, float(i % 7), float(i > 20)) for i in range(40)], "doc_id long, word_count double, label double")
    d = d.withColumns({f: F.col("word_count") for f in Q.FEATURES if f != "word_count"})
    monkeypatch.setattr(Q, "_training", lambda spark, sf_dir: d)
    asked = []
    monkeypatch.setattr(models, "fit", lambda df, features, label, regressor=None: asked.append(regressor) or RuntimeError)
    monkeypatch.setattr(models, "predict", lambda df, model: df.withColumn("prediction", F.lit(0.0)))
    Q.gbt_fit(spark, "")
    assert [r.getMaxIter() for r in asked] == [100]


def test_prefix_sums_and_median(spark):
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 1000):
        x = rng.integers(0, max(2, n // 3), n) / 8
        d = spark.createDataFrame([(float(v),) for v in x], "v double").repartition(3)
        assert R.median(d, "v").first().median == pytest.approx(float(np.median(x)))
        counts = d.groupBy("v").agg(F.count(F.lit(1)).cast("double").alias("k"))
        for r in R.prefix_sums(counts, "v", ["k"], parts=5).collect():
            assert r.before_k == (x < r.v).sum()
    none = spark.createDataFrame([], "v double")
    assert R.median(none, "v").first().median is None and R.summary(none, "v").first().n == 0


def test_scaling_is_fitted_on_the_training_part(spark):
    d = spark.createDataFrame([(i, float(i)) for i in range(20)], "k long, x double")
    got = {r.k: r.x for r in R.standard_scale(d, ["x"], ~R.holdout(F.col("k"))).collect()}
    known = np.array([i for i in range(20) if i % 5])
    assert got == pytest.approx({i: (i - known.mean()) / known.std() for i in range(20)})


def test_judged_number(spark):
    d = spark.createDataFrame([("about 0.7, or 0.9",), ("-0.4",), ("12",), ("no",), (None,)], "t string")
    from quillmark.functions import metrics as M

    assert [r.x for r in d.select(M.judged_number(F.col("t")).alias("x")).collect()] == [0.7, 0.4, 1.0, None, None]


def test_one_file_of_all_tasks(spark, tmp_path):
    """Bytes are those of the texts in order, in one file, however many tasks wrote it."""
    rows = [(k % 50 if k % 7 else None, f"line {k} é日本" * (k % 3)) for k in range(300)] + [(3, "same"), (3, "same"), (1, None)]
    d = spark.createDataFrame(rows, "k int, t string").repartition(7)
    path = str(tmp_path / "x" / "all.txt")
    size = io.write_one_text(d, "t", path, ["k"])
    want = "".join(t + "\n" for _, t in sorted(((k is not None, k or 0), t) for k, t in rows if t)).encode()
    assert (tmp_path / "x" / "all.txt").read_bytes() == want and size == len(want)
    assert io.write_one_text(d.limit(0), "t", path, ["k"]) == 0 and (tmp_path / "x" / "all.txt").read_bytes() == b""
    assert [p.name for p in (tmp_path / "x").iterdir()] == ["all.txt"]


def test_settings_of_a_run():
    a, b = audio.drawn(1), audio.drawn(2)
    assert a == audio.drawn(1) and a != b and all(0.9 <= x.stretch <= 1.1 and abs(x.pitch_steps) <= 2 and 0.8 <= x.volume <= 1.2 for x in (a, b))
    tone, hum = np.sin(np.arange(4000) / 5), np.sin(np.arange(900) / 50)
    how = audio.drawn(3, kind="background_noise")
    mixed = audio.augment(tone * 0.5, how, hum)
    ratio = (tone * 0.5) @ (tone * 0.5) / ((mixed - tone * 0.5) @ (mixed - tone * 0.5))
    assert ratio == pytest.approx(10 ** (how.snr_db / 10), rel=0.05)


def test_stretched_phases_are_those_of_angles():
    def by_angles(x, rate):
        s = audio.spectrogram(x)
        at = np.arange(0, len(s) - 1 + 1e-9, rate)
        s = np.vstack((s, np.zeros((2, s.shape[1]))))
        left, share = at.astype(int), (at % 1)[:, None]
        phase = np.angle(s[0]) + np.vstack((np.zeros(s.shape[1]), np.cumsum((np.angle(s[left + 1]) - np.angle(s[left]))[:-1], axis=0)))
        size = (1 - share) * np.abs(s[left]) + share * np.abs(s[left + 1])
        return audio._overlapped(size * np.exp(1j * phase), int(round(len(x) / rate)))

    rng = np.random.default_rng(5)
    for n in (1, 5, 700, 8000, 16001):
        x = rng.standard_normal(n) * 0.3
        for rate in (0.9, 1.07):
            assert np.allclose(audio.time_stretch(x, rate), by_angles(x, rate), atol=1e-9)
    assert not audio.time_stretch(np.zeros(3000), 1.1).any()


def test_fast_sizes():
    smooth = sorted(2**a * 3**b * 5**c for a in range(13) for b in range(9) for c in range(6))
    assert [audio.fast_size(n) for n in range(1, 4000)] == [next(k for k in smooth if k >= n) for n in range(1, 4000)]


def test_clips_are_written_with_their_columns(spark, tmp_path):
    """What a table knows of its clips comes with the files, so that it needn't be staged with their content to be joined again."""
    d = spark.createDataFrame([("a/x.wav", 1, "x_1.wav", b"12345")], "path string, variant int, name string, content binary")
    files = audio.write_clips(d, f"file://{tmp_path}/out", ("path", "variant"))
    assert [tuple(r) for r in files.select("path", "variant", "size").collect()] == [("a/x.wav", 1, 5)] and (tmp_path / "out/x_1.wav").read_bytes() == b"12345"
