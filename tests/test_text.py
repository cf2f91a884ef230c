"""Text functions on edge rows and goldens."""

import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quillmark.functions import edit, json as js, metrics as M, numbers as N, text as T

EDGES = ["", "   ", "e", "a😀 a_b c", "ss: Hi\nps: A: b", "The Big Dog\nCat x Y Zed Two", "lead\nss: x\nmore", "दे शुड", None, "a a A b"]


def one(spark, col, text):
    return spark.createDataFrame([(text,)], "t string").select(col.alias("x")).first().x


def test_tokens(spark):
    rows = spark.createDataFrame([(t,) for t in EDGES], "t string").select("t", T.tokens("t").alias("w")).collect()
    for r in rows:
        assert r.w == (None if r.t is None else r.t.split())


def test_edges_never_fail(spark):
    d = spark.createDataFrame([(t,) for t in EDGES], "t string")
    w = T.tokens("t")
    out = d.select(T.preprocess("t"), T.adjacent_repetition(w), T.global_repetition(w), T.char_diversity("t"), T.punct_ratio("t"), T.digit_ratio("t"), T.special_ratio("t"), T.syllables("t"), T.mean_word_length(w), T.compound_noun_hits("t"), T.fragments("t"), T.chunks(T.fragments("t"), 10), T.chunks(w, 200, 180), T.clean("t"), N.normalize_numbers("t"), N.numbers("t"))
    assert len(out.collect()) == len(EDGES)


@pytest.mark.parametrize("text,expected", [("", 0.0), ("a a", 2.5), ("a A b", 5 / 3), ("a b c", 0.0)])
def test_adjacent_repetition(spark, text, expected):
    assert one(spark, T.adjacent_repetition(T.tokens("t")), text) == pytest.approx(expected)


@pytest.mark.parametrize("text,expected", [("", 0.0), ("a a a b b c", 2 / 6), ("a A", 0.0)])
def test_global_repetition(spark, text, expected):
    assert one(spark, T.global_repetition(T.tokens("t")), text) == pytest.approx(expected)


def test_nouns_have_positions(spark):
    text = "The Big Dog\nCat x Y Zed Two"
    hits = one(spark, T.compound_noun_hits("t"), text)
    want = [(m.group(0), m.start(), m.end()) for m in re.finditer(T.NOUN, text)]
    assert [(h.noun, h.start_pos, h.end_pos) for h in hits] == want and want


def test_preprocess(spark):
    assert one(spark, T.preprocess("t"), "ss: Hello  World\nps: A (0:01-0:02.5) b") == "hello world a b"


def test_replace_first_and_ten_fixes(spark):
    assert one(spark, T.replace_first("t", F.lit("b"), F.lit("X")), "a b b") == "a X b"
    fixes = F.array(*(F.struct(F.lit("a").alias("old"), F.lit("b").alias("new")) for _ in range(12)))
    assert one(spark, T.replace_nouns("t", fixes), "a" * 12) == "b" * 10 + "aa"


def test_chunks_cover_all_words(spark):
    text = " ".join(map(str, range(1847)))
    got = one(spark, T.chunks(T.tokens("t"), 200, 180), text)
    assert len(got) == 11 and got[-1].split()[0] == "1800" and {w for c in got for w in c.split()} == set(text.split())


def test_char_diff(spark):
    d = spark.createDataFrame([("abc", "axcd"), ("", "a"), (None, "a")], "a string, b string").select(T.char_diff("a", "b").alias("x")).collect()
    assert [r.x for r in d] == [1, 0, 0]


def test_syllables(spark):
    assert [one(spark, T.syllables("t"), x) for x in ("", "e", "banana", "Ice cream e")] == [1, 1, 3, 3]


words = st.lists(st.sampled_from("abcde"), max_size=12)


def dp(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@given(words, words)
@settings(max_examples=200, deadline=None)
def test_alignment_distance(a, b):
    d, h = edit.align(a, b)
    assert d == dp(a, b) == edit.levenshtein(a, b) and 0 <= h <= min(len(a), len(b)) and edit.align(a, a) == (0, len(a))


def test_word_distance_column(spark):
    rows = [("a b c".split(), "a c d".split()), ([], ["x"]), (["x"], []), ([], []), ("क ख".split(), "क".split())]
    out = spark.createDataFrame(rows, "r array<string>, h array<string>").select(edit.word_distance(F.col("r"), F.col("h")).alias("d")).collect()
    assert [r.d for r in out] == [dp(a, b) for a, b in rows]


def test_distance_of_long_texts_with_many_words(spark):
    import random

    rng = random.Random(5)
    a = [f"w{rng.randrange(40000)}" for _ in range(700)] + [f"u{k}" for k in range(40000)]
    b = [w for i, w in enumerate(a) if i % 9 != 4] + ["x"]
    d = spark.createDataFrame([(a, b), (a[:700], b[:600])], "r array<string>, h array<string>").select(edit.word_distance(F.col("r"), F.col("h")).alias("d")).collect()
    assert [r.d for r in d] == [len(a) - len(b) + 2, dp(a[:700], b[:600])]


def test_smoke_pair(spark):
    d = spark.createDataFrame([("buy HDFC", "buy HSBC")], "r string, h string").select(T.tokens("r").alias("r"), T.tokens("h").alias("h"), F.col("r").alias("rt"), F.col("h").alias("ht"))
    x = d.select(edit.error_rate(edit.word_distance(F.col("r"), F.col("h")), F.size("r"), F.size("h")).alias("wer"), M.jaccard_folded(F.col("r"), F.col("h")).alias("j"), M.number_accuracy("rt", "ht").alias("n"), T.adjacent_repetition("h").alias("rep")).first()
    assert (x.wer, x.n, x.rep) == (0.5, 1.0, 0.0) and x.j == pytest.approx(1 / 3)


def test_grades_and_buckets(spark):
    d = spark.createDataFrame([(x,) for x in (0.0999, 0.1, 0.2, 0.3, 0.5, None)], "w double").select(M.grade(F.col("w")).alias("g")).collect()
    assert [r.g for r in d] == [5, 4, 3, 2, 1, 3]
    d = spark.createDataFrame([(x,) for x in (0.8, 0.6, 0.4, 0.39)], "w double").select(M.bucket(F.col("w")).alias("b")).collect()
    assert [r.b for r in d] == ["excellent", "good", "fair", "poor"]
    assert sum(M.WEIGHTS.values()) == pytest.approx(1.0)


def test_confidences(spark):
    d = spark.createDataFrame([([0.4, 0.9],), ([],), (None,)], "c array<double>")
    x = d.select(*(c.alias(k) for k, c in M.confidence_stats(F.col("c")).items())).collect()
    assert x[0].mean_confidence == pytest.approx(0.65) and x[0].std_confidence == pytest.approx(0.25) and x[0].low_confidence_ratio == 0.5
    assert x[1].mean_confidence == 0.8 and x[1].high_confidence_ratio == 0.0 and x[2].min_confidence == 0.8


def test_stt_shapes(spark):
    replies = [
        ('{"diarized_transcript":{"entries":[{"start_time_seconds":1,"end_time_seconds":2,"transcript":"a","speaker_id":"s"}]},"segments":[]}', [(1.0, 2.0, "a", "s")]),
        ('{"segments":[{"start":1,"end_time":2,"transcript":"a"}]}', [(1.0, 2.0, "a", "SPEAKER_00")]),
        ('{"results":[{"x":1},{"segments":[{"text":"b","speaker_label":"q"}]},{"segments":[{"text":"c"}]}]}', [(0.0, 0.0, "b", "q")]),
        ('{"data":{"segments":[{"text":"b"}]}}', [(0.0, 0.0, "b", "SPEAKER_00")]),
        ('{"transcript":"whole"}', [(0.0, 0.0, "whole", "SPEAKER_00")]),
        ("broken", []),
        (None, []),
    ]
    for reply, want in replies:
        assert [tuple(s) for s in one(spark, js.stt_segments(F.col("t")), reply)] == want


def test_fenced(spark):
    for text, want in [('x ```json\n{"a": 1}\n``` y', 1), ('{"a": 2}', 2), ("no", None)]:
        assert one(spark, js.fenced_object(F.col("t"), "a int")["a"], text) == want
    assert one(spark, js.word_confidences(F.col("t")), '{"timestamps":{"words":["x",{"confidence":0.3},{"w":1}]}}') == [0.8, 0.3, 0.8]


def full_table(a, b):
    """(distance, hits): cost first, then the most hits, cell by cell."""
    row = [(j, 0) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        above, row = row, [(i, 0)]
        for j, y in enumerate(b, 1):
            aside = (above[j - 1][0], above[j - 1][1] - 1) if x == y else (above[j - 1][0] + 1, above[j - 1][1])
            row.append(min(aside, (above[j][0] + 1, above[j][1]), (row[j - 1][0] + 1, row[j - 1][1])))
    return row[-1][0], -row[-1][1]


@pytest.mark.parametrize("many,cells", [(96, 1 << 14), (4, 64), (10**6, 1)])
def test_alignment_on_diagonals(monkeypatch, many, cells):
    import random

    import numpy as np

    monkeypatch.setattr(edit, "MANY", many)
    monkeypatch.setattr(edit, "CELLS", cells)
    rng = random.Random(many)
    pairs = []
    for k in range(120):
        words = rng.choice([2, 4, 30])
        a = [rng.randrange(words) for _ in range(rng.randrange(60))]
        b = [rng.randrange(words) for _ in range(rng.randrange(60))] if k % 2 else [99 if rng.random() < 0.1 else w for w in a if rng.random() < 0.85]
        pairs.append((np.array(a, np.int32), np.array(b, np.int32)))
    want = [full_table(a.tolist(), b.tolist()) for a, b in pairs]
    assert edit.solve(iter(pairs)) == want and [d for d, _ in edit.solve(iter(pairs), hits=False)] == [d for d, _ in want]
    assert [edit.align(a.tolist(), b.tolist()) for a, b in pairs] == want
