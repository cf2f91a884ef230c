"""Span joins against plain loops, and nouns heard again."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.operators import audio, intervals as I, stt
from quillmark.plans import rehear as R


@pytest.mark.parametrize("width", [0.7, 5.0, 1000.0])
def test_overlap_join(spark, width):
    rng = random.Random(4)
    spans = lambda n: [(rng.choice("xy"), i, a := round(rng.uniform(-20, 60), 2), round(a + rng.choice([0, 0.5, 3, 40]), 2)) for i in range(n)]
    left, right = spans(60) + [("x", 100, None, 1.0), ("x", 101, 5.0, 4.0)], spans(60) + [(None, 100, 1.0, 2.0)]
    a, b = spark.createDataFrame(left, "k string, i int, a double, b double"), spark.createDataFrame(right, "k string, j int, c double, d double")
    got = sorted((r.i, r.j, round(r.overlap, 6)) for r in I.overlap_join(a, b, ["k"], ("a", "b"), ("c", "d"), width).collect())
    want = sorted((i, j, round(min(z, w) - max(x, y), 6)) for k, i, x, z in left for m, j, y, w in right if k == m and x is not None and min(z, w) > max(x, y))
    assert got == want and len(want) > 100


SEGMENTS = [("r", 0, 0.0, 10.0, "we met Big Bird today"), ("r", 1, 9.0, 20.0, "then Cookie Monster and Big Bird again"), ("s", 0, 0.0, 5.0, "no names"), ("t", 0, 1.0, 1.0, "Big Bird")]


def test_second_hearing(spark):
    segments = spark.createDataFrame(SEGMENTS, "recording string, pos int, start_ts double, end_ts double, transcript string")
    nouns = {(r.recording, r.idx): r for r in R.timed_nouns(segments).collect()}
    assert {k: n.noun for k, n in nouns.items()} == {("r", 1): "Big Bird", ("r", 2): "Cookie Monster", ("r", 3): "Big Bird", ("t", 1): "Big Bird"}
    first, second = nouns["r", 1], nouns["r", 2]
    words = [("r", first.noun_start + 0.1, first.noun_start + 0.2, "Pig"), ("r", first.noun_start, first.noun_start + 0.1, "A"), ("r", second.noun_start - 1.0, second.noun_start + 0.2, "mostly before"), ("s", 0.0, 5.0, "x")]
    heard = R.SecondHearing(spark.createDataFrame(words, "recording string, word_start double, word_end double, word string"))
    out = {r.recording: (r.original, r.corrected, r.n_nouns, r.n_heard) for r in R.rehear(segments, heard).collect()}
    text = "we met Big Bird today then Cookie Monster and Big Bird again"
    # the third noun's own words replace the first place that still has them, by themselves
    assert out == {"r": (text, text.replace("Big Bird", "A Pig", 1), 3, 1), "s": ("no names", "no names", 0, 0), "t": ("Big Bird", "Big Bird", 1, 0)}
    assert {r.recording: r.n_nouns for r in R.rehear(segments, heard, most=1).collect()}["r"] == 1
    assert R.rehear(segments.limit(0), heard).count() == 0


def samples(content, language):
    x, rate = audio.decode_wav(content)
    return json.dumps({"transcript": f"{len(x)}@{rate}"})


def test_clips(spark):
    """The clip with the most of a noun is cut to it, from its own beginning; equal slices are heard once."""
    wav = audio.encode_wav(np.zeros(8000 * 12), 8000)
    rows = [("r", 0.0, 12.0, "a.wav", wav), ("r", 8.0, 20.0, "b.wav", wav), ("s", 0.0, 12.0, "c.wav", wav)]
    clips = spark.createDataFrame(rows, "recording string, clip_start double, clip_end double, audio_path string, content binary")
    segments = spark.createDataFrame(SEGMENTS, "recording string, pos int, start_ts double, end_ts double, transcript string")
    nouns = {r.idx: r for r in R.timed_nouns(segments).where(F.col("recording") == "r").collect()}
    spans = R.timed_nouns(segments).select("recording", "noun_start", "noun_end")
    got = {round(r.noun_start, 6): r.reply for r in R.ClipHearing(clips, stt.RemoteReplies(samples)).replies(spans).collect()}
    for k, start in ((1, 0.0), (2, 8.0), (3, 8.0)):
        n = nouns[k]
        clip = 0.0 if min(n.noun_end, 12.0) - n.noun_start >= min(n.noun_end, 20.0) - max(n.noun_start, 8.0) else 8.0
        want = int((min(n.noun_end, clip + 12) - clip) * 8000) - int((n.noun_start - clip) * 8000)
        assert got[round(n.noun_start, 6)] == f"{want}@8000" and (clip == start or k == 2)
    corrected = R.rehear(segments, R.ClipHearing(clips, stt.RemoteReplies(samples))).where(F.col("recording") == "r").first()
    assert corrected.n_heard == 3 and "Big Bird" not in corrected.corrected and corrected.corrected.count("@8000") == 3
