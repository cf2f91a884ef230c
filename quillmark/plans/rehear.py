"""Nouns of a transcript heard again: times from the segments, slices of the sound or of a second hearing, and the text repaired."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.text import replace_nouns
from ..operators.intervals import overlap_join
from ..operators.segments import full_text, noun_times
from ..operators.stt import SttBackend, transcribe_slices

#: Seconds of a bin in which spans meet.
WIDTH = 10.0


class Hearing(Protocol):
    name: str

    def replies(self, spans: DataFrame) -> DataFrame:
        """(recording, noun_start, noun_end, reply) of distinct spans; a span without a reply may be absent."""


class SecondHearing:
    """Timed words (recording, word_start, word_end, word) of another recogniser: a span says the words that lie in it by half or
    more of their time, in order."""

    name = "second"

    def __init__(self, words: DataFrame):
        self.words = words

    def replies(self, spans: DataFrame) -> DataFrame:
        both = overlap_join(spans, self.words, ["recording"], ("noun_start", "noun_end"), ("word_start", "word_end"), WIDTH)
        both = both.where(F.col("overlap") >= 0.5 * (F.col("word_end") - F.col("word_start")))
        said = F.array_sort(F.collect_list(F.struct("word_start", "word")))  # a span's words
        return both.groupBy("recording", "noun_start", "noun_end").agg(F.array_join(F.transform(said, lambda x: x["word"]), " ").alias("reply"))


class ClipHearing:
    """Sound clips (recording, clip_start, clip_end, audio_path, content) given to a recogniser: of the clips that a span is in, the
    one with the most of it, the earliest of equal ones, cut to the span."""

    name = "clips"

    def __init__(self, clips: DataFrame, backend: SttBackend, language: str = "en"):
        self.clips, self.backend, self.language = clips, backend, language

    def replies(self, spans: DataFrame) -> DataFrame:
        times = self.clips.select("recording", "clip_start", "clip_end", "audio_path")
        both = overlap_join(spans, times, ["recording"], ("noun_start", "noun_end"), ("clip_start", "clip_end"), WIDTH)
        best = F.max_by(F.struct("audio_path", "clip_start", "clip_end"), F.struct("overlap", -F.col("clip_start"), "audio_path")).alias("clip")
        cuts = both.groupBy("recording", "noun_start", "noun_end").agg(best).select("recording", "noun_start", "noun_end", "clip.*")
        cuts = cuts.withColumn("start_ts", F.greatest("noun_start", "clip_start") - F.col("clip_start")).withColumn("end_ts", F.least("noun_end", "clip_end") - F.col("clip_start"))
        # the sound is joined to the slices alone, and each slice is heard once
        sounds = cuts.select("audio_path", "start_ts", "end_ts").distinct().join(self.clips.select("audio_path", "content").dropDuplicates(["audio_path"]), "audio_path")
        heard = transcribe_slices(sounds, self.backend, self.language)
        return cuts.join(heard, ["audio_path", "start_ts", "end_ts"]).select("recording", "noun_start", "noun_end", F.col("transcript").alias("reply"))


def timed_nouns(segments: DataFrame, most: int | None = None) -> DataFrame:
    """(recording, idx, noun, noun_start, noun_end) of segments (recording, pos, start_ts, end_ts, transcript): compound nouns in the
    order of the transcript, the first ``most`` of each recording. Segments may overlap in time."""
    rows = segments.select("recording", "pos", "start_ts", "end_ts", "transcript")
    nouns = noun_times(rows).select("recording", "pos", "noun", "noun_start", "noun_end")
    nouns = nouns.withColumn("idx", F.row_number().over(W.partitionBy("recording").orderBy("pos", "noun_start", "noun_end", "noun")))
    return nouns.where(F.col("idx") <= most).drop("pos") if most else nouns.drop("pos")


def rehear(segments: DataFrame, hearing: Hearing, most: int = 10) -> DataFrame:
    """(recording, original, corrected, n_nouns, n_heard): each recording's transcript, and it with its first nouns as they were heard
    again.

    A noun's first occurrence in the text so far is replaced, noun by noun. Equal spans are heard once; a noun that isn't heard stays.
    """
    nouns = timed_nouns(segments, most)
    replies = hearing.replies(nouns.select("recording", "noun_start", "noun_end").distinct()).where(F.length("reply") > 0)
    fixed = nouns.join(replies, ["recording", "noun_start", "noun_end"], "left")
    fixes = F.array_sort(F.collect_list(F.struct("idx", F.col("noun").alias("old"), F.coalesce("reply", "noun").alias("new"))))  # ``most`` of them
    fixed = fixed.groupBy("recording").agg(fixes.alias("fixes"), F.count(F.lit(1)).alias("n_nouns"), F.count("reply").alias("n_heard"))
    texts = full_text(segments, "recording", "pos", "transcript").withColumnRenamed("transcript", "original")
    out = texts.join(fixed, "recording", "left").withColumn("corrected", F.coalesce(replace_nouns("original", "fixes", most), "original"))
    return out.select("recording", "original", "corrected", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_nouns", "n_heard")))
