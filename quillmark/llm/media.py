"""Texts kept as sound: 8-bit WAV columns, read by the wave module, and fingerprints of pairs of spectral peaks."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

RATE, BLOCK = 8000, 64
#: Samples of a frame, samples between frames, and frames that are transformed at once.
FRAME, HOP, FRAMES = 256, 128, 2048
#: First bins of the bands; a band has one peak a frame at most.
BANDS = (1, 9, 17, 33, 65, 129)
#: Pairs of a peak: with the next ``FAN`` peaks of later frames, at most ``REACH`` frames later.
FAN, REACH = 3, 63

_WINDOW = np.hanning(FRAME + 1)[:-1]


def padded(payload: bytes) -> bytes:
    """With bytes 0 up to a positive multiple of 64."""
    return payload + bytes(max(-len(payload) % BLOCK, 0 if payload else BLOCK))


def encode_wav(payload: bytes) -> bytes:
    """One channel of 8-bit samples, a byte each."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def read_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not one channel of 8-bit samples")
        return w.readframes(w.getnframes())


def spectrum(samples: np.ndarray) -> Iterator[np.ndarray]:
    """Levels of bins 0 to 128, a row per frame, ``FRAMES`` rows at a time: the logarithm of the power in 64ths, as whole numbers,
    so that the last bits of a transform decide nothing. The last frame is filled up with silence."""
    n = max(-(-(len(samples) - FRAME) // HOP), 0) + 1
    for at in range(0, n, FRAMES):
        here = min(FRAMES, n - at)
        x = np.zeros((here - 1) * HOP + FRAME, np.float32)
        own = samples[at * HOP : at * HOP + len(x)]
        x[: len(own)] = own.astype(np.float32) - 128
        frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
        z = np.fft.rfft(frames * _WINDOW, axis=1)
        yield np.rint(64 * np.log2(1 + (z.real * z.real + z.imag * z.imag))).astype(np.int32)


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of the peaks, by frame, then bin: in each band the highest bin of a frame (the lowest of equal ones), if it is
    above the band's of the frame before and not under that of the next."""
    level, place = [], []
    for s in spectrum(samples):
        cuts = [s[:, a:b] for a, b in zip(BANDS, BANDS[1:], strict=False)]
        level.append(np.stack([c.max(1) for c in cuts], 1))
        place.append(np.stack([c.argmax(1) + a for c, a in zip(cuts, BANDS, strict=False)], 1))
    top, bins = np.concatenate(level), np.concatenate(place)
    edge = np.zeros((1, top.shape[1]), top.dtype)
    held = (top > np.concatenate([edge, top[:-1]])) & (top >= np.concatenate([top[1:], edge]))
    frames, band = np.nonzero(held)
    return frames, bins[frames, band]


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """Time-coded pairs in ascending order: frame << 24 | bin << 16 | partner's bin << 8 | frames between."""
    t, f = peaks(samples)
    if not len(t):
        return np.zeros(0, np.int64)
    after = np.searchsorted(t, t, side="right")  # the first peak of a later frame
    with_ = after[:, None] + np.arange(FAN)
    there = with_ < len(t)
    with_ = np.minimum(with_, len(t) - 1)
    gap = t[with_] - t[:, None]
    codes = (t[:, None].astype(np.int64) << 24) | (f[:, None].astype(np.int64) << 16) | (f[with_].astype(np.int64) << 8) | gap
    return np.sort(codes[there & (gap <= REACH)])


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            texts = [(t or "").encode() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array([encode_wav(padded(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])


def wav_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text in UTF-8) and media: the text as a WAV file's bytes, in a table in the shared folder.

    Null texts are empty: 64 samples of 0. Texts are kept whole, row by row; repeated rows are kept as often; an empty table gives
    none. Other columns aren't read.
    """
    common.ship(docs.sparkSession)
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_stored, "doc_id long, n_bytes long, media binary")
    path = common.new_path(docs.sparkSession, "media")
    made.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(made.schema).parquet(path)


READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, pairs array<long>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
    names = [c.split()[0] for c in READ.split(", ")]
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part, rows = b.slice(at, 256), []
            for media in part.column("media"):
                media = media.as_buffer()
                payload = read_wav(media)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), media.size, hashlib.sha256(media).hexdigest(), fingerprint(np.frombuffer(payload, np.uint8))))
            made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds[2:], strict=True)] if rows else [pa.array([], t) for t in kinds[2:]]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *made], names=names)


def read_media(media: DataFrame) -> DataFrame:
    """Of each row's media (doc_id, n_bytes, media): what the samples hold, and the fingerprint's time-coded pairs as an array."""
    common.ship(media.sparkSession)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read, READ)


def with_feature(rows: DataFrame) -> DataFrame:
    """The pairs as one string: how many there are and the SHA-256 of their decimal numbers, joined by commas."""
    digest = F.sha2(F.array_join(F.transform("pairs", lambda x: x.cast("string")), ","), 256)
    return rows.withColumn("feature", F.concat(F.size("pairs").cast("string"), F.lit(":"), digest))
