"""Speech-to-text sources: a recogniser behind one protocol, with replies that were made before as the default."""

from __future__ import annotations

import wave
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.json import stt_segments
from ..ship import ship
from .audio import cut, decode_wav, encode_wav


class SttBackend(Protocol):
    name: str

    def replies(self, clips: DataFrame, language: str) -> DataFrame:
        """``clips`` (audio_path, ...) with ``reply``, a JSON string or null."""


class PrecomputedReplies:
    """Replies from a table of (audio_path, reply [, language])."""

    name = "precomputed"

    def __init__(self, table: DataFrame):
        self.table = table

    def replies(self, clips: DataFrame, language: str) -> DataFrame:
        known = self.table.where(F.col("language") == language).drop("language") if "language" in self.table.columns else self.table
        return clips.join(known.dropDuplicates(["audio_path"]), "audio_path", "left")


class RemoteReplies:
    """A user's function of (audio_path, language), or of (bytes, language) where clips have ``content``; what raises has no reply."""

    name = "remote"

    def __init__(self, call: Callable[[object, str], str | None]):
        self.call = call

    def replies(self, clips: DataFrame, language: str) -> DataFrame:
        ship(clips.sparkSession)
        call, what = self.call, "content" if "content" in clips.columns else "audio_path"

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                out = []
                for x in f[what]:
                    try:
                        out.append(call(x, language))
                    except Exception:  # whatever a user's client raises: this clip has no reply
                        out.append(None)
                yield f.assign(reply=out)

        schema = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in clips.schema.fields)
        return clips.mapInPandas(run, f"{schema}, reply string")


def transcribe(clips: DataFrame, backend: SttBackend, language: str = "hi") -> DataFrame:
    """``clips`` with ``reply`` and the backend's name: a call per clip."""
    return backend.replies(clips, language).withColumn("backend", F.lit(backend.name))


def transcribe_batch(clips: DataFrame, backend: SttBackend, language: str = "hi") -> DataFrame:
    """audio_path, pos, start_ts, end_ts, transcript, speaker of all clips: what a batch job's files would be decoded to."""
    return transcribe(clips, backend, language).select("audio_path", F.posexplode(stt_segments(F.col("reply"))).alias("pos", "s")).select("audio_path", "pos", "s.*")


def slices(clips: DataFrame) -> DataFrame:
    """Clips (audio_path, content, start_ts, end_ts) cut to their times, as WAV at the clip's rate; null what can't be decoded."""
    ship(clips.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for content, a, z in zip(f["content"], f["start_ts"], f["end_ts"], strict=True):
                try:
                    x, rate = decode_wav(content)
                    out.append(encode_wav(cut(x, a, z, rate), rate))
                except (wave.Error, ValueError, EOFError, TypeError):
                    out.append(None)
            yield f.assign(content=out)

    return clips.select("audio_path", "content", "start_ts", "end_ts").mapInPandas(run, "audio_path string, content binary, start_ts double, end_ts double")


def transcribe_slices(clips: DataFrame, backend: SttBackend, language: str = "hi") -> DataFrame:
    """audio_path, start_ts, end_ts, transcript: each slice heard again; the slice's own samples go to the backend."""
    found = transcribe(slices(clips), backend, language)
    said = F.array_join(F.transform(stt_segments(F.col("reply")), lambda s: s["transcript"]), " ")
    return found.select("audio_path", "start_ts", "end_ts", F.coalesce(said, F.lit("")).alias("transcript"))
