"""Waveform operators on numpy arrays: augmentation, prosody and fluency features; rows go through ``mapInPandas``.

Spectra, mel bands, the phase vocoder and the pitch tracker are written out here with numpy's transforms: no signal library is
needed. Numbers come near those of the usual libraries, which differ among themselves, and aren't equal to them.
"""

from __future__ import annotations

import io
import os
import uuid
import wave
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..ship import ship

RATE = 16000


#: Kinds of augmentation; ``all`` is every enabled one, in this order. Fixed values.
KINDS = ("white_noise", "background_noise", "time_stretch", "pitch_shift", "reverb", "volume", "all")
#: Samples of a frame and between two; pitch limits in Hz (two and seven octaves' C); share of energy under the rolloff; bands.
FRAME, HOP, LOW, HIGH, ROLLOFF, MELS, MFCCS = 2048, 512, 65.406, 2093.005, 0.85, 40, 13


@dataclass
class Augmentation:
    noise_level: float = 0.005
    snr_db: float = 20.0
    stretch: float = 1.1
    pitch_steps: float = 2.0
    volume: float = 0.9
    white_noise: bool = True
    background_noise: bool = False
    time_stretch: bool = False
    pitch_shift: bool = False
    reverb: bool = False
    change_volume: bool = True
    kind: str = "all"
    seed: int = 0

    def has(self, step: str) -> bool:
        return self.kind in (step, "all") and (self.change_volume if step == "volume" else getattr(self, step))


def drawn(seed: int, **more) -> Augmentation:
    """Settings of a run: every step, tempo and volume drawn within a tenth and a fifth, pitch within two steps."""
    rng = np.random.default_rng(seed)
    how = {"stretch": 1 + rng.uniform(-0.1, 0.1), "pitch_steps": rng.uniform(-2, 2), "volume": 1 + rng.uniform(-0.2, 0.2)}
    return Augmentation(**{"background_noise": True, "time_stretch": True, "pitch_shift": True, "reverb": True} | how | more)


def white_noise(x: np.ndarray, level: float, rng: np.random.Generator) -> np.ndarray:
    return x + level * rng.standard_normal(len(x))


def background_noise(x: np.ndarray, noise: np.ndarray, snr_db: float, rng: np.random.Generator) -> np.ndarray:
    """Mixed at a signal-to-noise ratio; short noise is tiled, long noise cut at a random place. Silent noise adds nothing."""
    if not len(noise) or not len(x):
        return x
    if len(noise) < len(x):
        noise = np.tile(noise, -(-len(x) // len(noise)))[: len(x)]
    else:
        at = int(rng.integers(0, len(noise) - len(x) + 1))
        noise = noise[at : at + len(x)]
    power = float((noise**2).mean())
    return x if power == 0 else x + noise * np.sqrt(float((x**2).mean()) / (power * 10 ** (snr_db / 10)))


def fast_size(n: int) -> int:
    """The least length from ``n`` on that has no factor above 5: transforms of others take many times as long."""
    best = 1 << max(n - 1, 0).bit_length()
    five = 1
    while five < best:
        three = five
        while three < best:
            best = min(best, three << max(-(-n // three) - 1, 0).bit_length())
            three *= 3
        five *= 5
    return best


def resample(x: np.ndarray, rate: float, to: float) -> np.ndarray:
    """Band-limited to the lower of both rates, by the spectrum of the whole clip."""
    n = max(1, int(round(len(x) * to / rate)))
    if not len(x) or n == len(x):
        return x
    spectrum = np.fft.rfft(x)
    keep = min(len(spectrum), n // 2 + 1)
    out = np.zeros(n // 2 + 1, complex)
    out[:keep] = spectrum[:keep]
    return np.fft.irfft(out, n) * (n / len(x))


def spectrogram(x: np.ndarray) -> np.ndarray:
    """Complex spectra (frame, bin) of frames around every ``HOP`` samples."""
    padded = np.pad(x, FRAME // 2)
    parts = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    return np.fft.rfft(parts * np.hanning(FRAME + 1)[:-1], axis=1)


def _overlapped(spectra: np.ndarray, n: int) -> np.ndarray:
    """The waveform of ``n`` samples whose frames have these spectra, by weighted overlap."""
    window = np.hanning(FRAME + 1)[:-1]
    out, weight = (np.zeros(HOP * (len(spectra) - 1) + FRAME) for _ in range(2))
    square = window**2
    for k, part in enumerate(np.fft.irfft(spectra, FRAME, axis=1) * window):
        out[k * HOP : k * HOP + FRAME] += part
        weight[k * HOP : k * HOP + FRAME] += square
    out = (out / np.maximum(weight, 1e-8))[FRAME // 2 :]
    return np.pad(out, (0, max(0, n - len(out))))[:n]


def time_stretch(x: np.ndarray, rate: float) -> np.ndarray:
    """A phase vocoder: ``rate`` times as fast at the same pitch."""
    if not len(x) or rate == 1:
        return x
    s = spectrogram(x)
    at = np.arange(0, len(s) - 1 + 1e-9, rate)
    loud = np.abs(s)
    # a frame's phases as complex numbers of size 1, silent bins 1: what a bin's phase gains is a product, whole turns in it don't
    # matter, and neither angles nor their sines are worked out
    turn = np.divide(s, loud, out=np.ones_like(s), where=loud > 1e-150)
    loud, turn = np.pad(loud, ((0, 2), (0, 0))), np.pad(turn, ((0, 2), (0, 0)), constant_values=1)
    left = at.astype(int)
    share = (at - left)[:, None]
    out = np.empty((len(at), s.shape[1]), complex)
    out[0] = turn[0]
    np.multiply(turn[left[:-1] + 1], turn[left[:-1]].conj(), out=out[1:])
    np.cumprod(out, axis=0, out=out)
    out *= (1 - share) * loud[left] + share * loud[left + 1]
    return _overlapped(out, int(round(len(x) / rate)))


def pitch_shift(x: np.ndarray, steps: float) -> np.ndarray:
    """Made longer at the same pitch, then resampled to its length: half-tones higher."""
    if not len(x):
        return x
    ratio = 2 ** (steps / 12)
    y = resample(time_stretch(x, 1 / ratio), ratio, 1)
    return np.pad(y, (0, max(0, len(x) - len(y))))[: len(x)]


def reverb(x: np.ndarray, rng: np.random.Generator, rate: int = RATE) -> np.ndarray:
    """Convolved with a random falling impulse of a tenth of a second and normalised to a peak of 1; silence stays silence."""
    if not len(x):
        return x
    n = max(1, int(0.1 * rate))
    impulse = np.cumprod(np.concatenate(([1.0], 0.5 * rng.random(n - 1))))
    whole = len(x) + n - 1
    size = fast_size(whole)
    y = np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(impulse, size), size)[(n - 1) // 2 :][: len(x)]
    peak = np.abs(y).max(initial=0.0)
    return y / peak if peak > 1e-12 else np.zeros(len(x))


def augment(x: np.ndarray, c: Augmentation, noise: np.ndarray | None = None, rate: int = RATE) -> np.ndarray:
    """The enabled steps of the kind in order, clipped to -1..1."""
    rng = np.random.default_rng(c.seed)
    if c.has("white_noise"):
        x = white_noise(x, c.noise_level, rng)
    if c.has("background_noise") and noise is not None:
        x = background_noise(x, noise, c.snr_db, rng)
    if c.has("time_stretch"):
        x = time_stretch(x, c.stretch)
    if c.has("pitch_shift"):
        x = pitch_shift(x, c.pitch_steps)
    if c.has("reverb"):
        x = reverb(x, rng, rate)
    if c.has("volume"):
        x = x * c.volume
    return np.clip(x, -1.0, 1.0)


def pitch(x: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Hz of each frame, nan where it has no clear period: the first deep minimum of the normalised difference function."""
    padded = np.pad(x, FRAME // 2)
    parts = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    half, first, last = FRAME // 2, max(2, int(rate / HIGH)), min(FRAME // 2 - 1, int(rate / LOW) + 1)
    size = 2 * FRAME
    head = np.fft.rfft(parts[:, :half][:, ::-1], size, axis=1)
    cross = np.fft.irfft(head * np.fft.rfft(parts, size, axis=1), size, axis=1)[:, half - 1 : half - 1 + half]
    power = np.cumsum(np.pad(parts**2, ((0, 0), (1, 0))), axis=1)
    energy = power[:, half : FRAME] - power[:, : half]
    d = np.maximum(energy[:, :1] + energy - 2 * cross, 0.0)
    d[:, 0] = 0
    lags = np.arange(half)
    mean = np.cumsum(d, axis=1) / np.maximum(lags, 1)
    norm = np.where(mean > 0, d / np.maximum(mean, 1e-12), 1.0)
    out = np.full(len(parts), np.nan)
    for k, row in enumerate(norm):
        low = np.flatnonzero(row[first:last] < 0.15)
        if not len(low) or energy[k, 0] < 1e-6:
            continue
        lag = first + int(low[0])
        while lag + 1 < last and row[lag + 1] < row[lag]:
            lag += 1
        a, b, c = row[lag - 1], row[lag], row[lag + 1]
        bend = a - 2 * b + c
        out[k] = rate / (lag + (0.5 * (a - c) / bend if bend else 0.0))
    return out


def onsets(power: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames where new sound sets in, strength of every frame), from power spectra."""
    log = np.log1p(1000 * power)
    rise = np.concatenate(([0.0], np.maximum(np.diff(log, axis=0), 0).mean(1)))
    if len(rise) < 3 or rise.max() <= 1e-9:
        return np.zeros(0, int), rise
    rise = rise / rise.max()
    around = np.convolve(rise, np.ones(7) / 7, "same")
    peak = np.r_[False, (rise[1:-1] > rise[:-2]) & (rise[1:-1] >= rise[2:]), False] & (rise > around + 0.07)
    return np.flatnonzero(peak), rise


def tempo_of(strength: np.ndarray, rate: int = RATE) -> float:
    """Beats a minute: the lag between 40 and 240 at which the strengths agree best with themselves, near 120 preferred."""
    per_second = rate / HOP
    lags = np.arange(max(1, int(per_second * 60 / 240)), int(per_second * 60 / 40) + 1)
    lags = lags[lags < len(strength)]
    if not len(lags) or strength.max() <= 1e-9:
        return 0.0
    s = strength - strength.mean()
    match = np.array([(s[lag:] * s[:-lag]).sum() for lag in lags])
    beats = 60 * per_second / lags
    match = match * np.exp(-0.5 * np.log2(beats / 120) ** 2)
    return float(beats[np.argmax(match)]) if match.max() > 0 else 0.0


def mel_cepstra(power: np.ndarray, rate: int = RATE) -> np.ndarray:
    """(coefficient, frame): cosine transform of the log energies of bands that are equally wide in mel."""
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), MELS + 2)
    edges = 700 * (10 ** (mel / 2595) - 1)
    hz = np.arange(power.shape[1]) * rate / FRAME
    up = (hz - edges[:-2, None]) / np.diff(edges)[:-1, None]
    down = (edges[2:, None] - hz) / np.diff(edges)[1:, None]
    bands = np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]
    log = 10 * np.log10(np.maximum(power @ bands.T, 1e-10))
    log = np.maximum(log, log.max() - 80)
    k, n = np.arange(MFCCS)[:, None], np.arange(MELS)[None, :]
    basis = np.cos(np.pi * k * (2 * n + 1) / (2 * MELS)) * np.where(k == 0, np.sqrt(1 / MELS), np.sqrt(2 / MELS))
    return basis @ log.T


#: The features of a clip, in their order: fixed values.
PROSODY = ("f0_mean", "f0_std", "f0_range", "f0_median", "f0_slope", "f0_curvature", "energy_mean", "energy_std", "energy_range", "spectral_centroid_mean", "spectral_centroid_std", "spectral_rolloff_mean", "zero_crossing_rate_mean", "tempo", "speaking_rate", "pause_ratio", "voiced_ratio")
FLUENCY = ("disfluency_ratio", "spectral_stability", "rhythm_regularity", "mfcc_stability", "energy_consistency")


def _steady(x: np.ndarray) -> float:
    return float(1 - x.std() / x.mean()) if len(x) and x.mean() else 0.0


def clip_stats(x: np.ndarray, rate: int = RATE) -> dict[str, float]:
    """The 17 prosody and 5 fluency features; a clip without voiced frames has zeros for all of prosody, an empty one for all."""
    zeros = dict.fromkeys(PROSODY + FLUENCY, 0.0)
    if not len(x):
        return zeros
    if rate != RATE:
        x = resample(x, rate, RATE)
    s = np.abs(spectrogram(x))
    power = s**2
    parts = np.lib.stride_tricks.sliding_window_view(np.pad(x, FRAME // 2), FRAME)[::HOP]
    rms = np.sqrt((parts**2).mean(1))
    hz = np.arange(s.shape[1]) * RATE / FRAME
    total = s.sum(1)
    centroid = np.where(total > 1e-9, s @ hz / np.maximum(total, 1e-9), 0.0)
    rolloff = hz[np.argmax(np.cumsum(s, axis=1) >= ROLLOFF * total[:, None], axis=1)]
    crossing = (np.signbit(parts[:, 1:]) != np.signbit(parts[:, :-1])).mean(1)
    at, strength = onsets(power)
    step = np.diff(rms)
    gaps = np.diff(at)
    cepstra = mel_cepstra(power)
    spread = np.abs(cepstra).mean()
    fluency = {
        "disfluency_ratio": float((np.abs(step) > 2 * step.std()).mean()) if len(step) else 0.0, "spectral_stability": _steady(centroid), "rhythm_regularity": _steady(gaps) if len(at) > 1 else 0.0,
        "mfcc_stability": float(1 - cepstra.std(1).mean() / spread) if spread else 0.0, "energy_consistency": _steady(rms),
    }
    f0 = pitch(x)
    voiced = f0[~np.isnan(f0)]
    if not len(voiced):
        return zeros | fluency
    slope = np.diff(voiced)
    bend = np.diff(slope)
    return {
        "f0_mean": float(voiced.mean()), "f0_std": float(voiced.std()), "f0_range": float(voiced.max() - voiced.min()), "f0_median": float(np.median(voiced)),
        "f0_slope": float(slope.mean()) if len(slope) else 0.0, "f0_curvature": float(bend.mean()) if len(bend) else 0.0,
        "energy_mean": float(rms.mean()), "energy_std": float(rms.std()), "energy_range": float(rms.max() - rms.min()),
        "spectral_centroid_mean": float(centroid.mean()), "spectral_centroid_std": float(centroid.std()), "spectral_rolloff_mean": float(rolloff.mean()), "zero_crossing_rate_mean": float(crossing.mean()),
        "tempo": tempo_of(strength), "speaking_rate": len(at) / (len(x) / RATE), "pause_ratio": float((rms < 0.01).mean()), "voiced_ratio": len(voiced) / len(f0),
    } | fluency


def decode_wav(content: bytes) -> tuple[np.ndarray, int]:
    """Mono samples in -1..1 and the rate, of PCM with 8, 16, 24 or 32 bits."""
    with wave.open(io.BytesIO(content)) as w:
        width, raw = w.getsampwidth(), w.readframes(w.getnframes())
        if width == 1:
            x = (np.frombuffer(raw, "u1").astype(np.float64) - 128) / 128
        elif width == 3:
            wide = np.zeros((len(raw) // 3, 4), "u1")
            wide[:, 1:] = np.frombuffer(raw, "u1")[: len(wide) * 3].reshape(-1, 3)
            x = wide.view("<i4").ravel() / 2.0**31
        else:
            x = np.frombuffer(raw, f"<i{width}") / 2.0 ** (8 * width - 1)
        return x.reshape(-1, w.getnchannels()).mean(1), w.getframerate()


def load(content: bytes, rate: int = RATE) -> np.ndarray:
    """Samples at ``rate``, whatever rate the file has."""
    x, own = decode_wav(content)
    return resample(x, own, rate)


def cut(x: np.ndarray, start: float, end: float, rate: int = RATE) -> np.ndarray:
    """The samples from ``start`` to ``end`` seconds."""
    return x[int(start * rate) : int(end * rate)]


def encode_wav(x: np.ndarray, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


_UNREADABLE = (wave.Error, ValueError, EOFError)


def wav_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of every WAV file below ``path``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", True).load(path).select("path", "content")


def stats_of(clips: DataFrame) -> DataFrame:
    """path and the 22 features of clips (path, content); one that can't be decoded has zeros."""
    ship(clips.sparkSession)
    names = [*PROSODY, *FLUENCY]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for p, content in zip(f["path"], f["content"], strict=True):
                try:
                    stats = clip_stats(*decode_wav(content))
                except _UNREADABLE:
                    stats = dict.fromkeys(names, 0.0)
                rows.append({"path": p} | stats)
            yield pd.DataFrame(rows, columns=["path", *names])

    return clips.select("path", "content").mapInPandas(run, "path string, " + ", ".join(f"{n} double" for n in names))


def clip_features(spark: SparkSession, path: str) -> DataFrame:
    return stats_of(wav_files(spark, path))


def variants(clips: DataFrame, n: int = 5, kinds=KINDS, key: str = "path") -> DataFrame:
    """Each clip ``n`` times, with variant (0 to n - 1), kind, name of the new file and seed, all by a hash of clip and variant."""
    mark = F.md5(F.concat_ws("#", F.col(key).cast("string"), F.col("variant").cast("string")))
    number = F.conv(F.substring("mark", 1, 6), 16, 10).cast("long")
    stem = F.regexp_extract(F.col(key).cast("string"), r"([^/]*?)(?:\.[^./]*)?$", 1)
    out = clips.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("mark", mark).withColumn("seed", number)
    out = out.withColumn("kind", F.array(*map(F.lit, kinds))[(F.col("seed") % len(kinds)).cast("int")]).drop("mark")
    return out.withColumn("name", F.concat(stem, F.lit("_aug_"), F.col("variant").cast("string"), F.lit("_"), F.col("kind"), F.lit(".wav")))


def augmented(clips: DataFrame, n: int = 5, how: Augmentation | None = None, noise: np.ndarray | None = None) -> DataFrame:
    """path, variant, kind, name, content (WAV at the clip's own rate) of ``n`` variants of each clip; what fails is left out.

    ``noise`` is small and goes to every task.
    """
    ship(clips.sparkSession)
    base = how or Augmentation(background_noise=True, time_stretch=True, pitch_shift=True, reverb=True)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                try:
                    x, rate = decode_wav(r.content)
                except _UNREADABLE:
                    continue
                c = Augmentation(**vars(base) | {"kind": r.kind, "seed": int(r.seed)})
                rows.append((r.path, r.variant, r.kind, r.name, encode_wav(augment(x, c, noise, rate), rate)))
            yield pd.DataFrame(rows, columns=["path", "variant", "kind", "name", "content"])

    rows = variants(clips.select("path", "content"), n).select("path", "content", "variant", "kind", "seed", "name")
    return rows.mapInPandas(run, "path string, variant int, kind string, name string, content binary")


def write_clips(rows: DataFrame, folder: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row's content as file ``name`` below ``folder`` (which executors and driver share); path and size of every file, and the
    columns of ``keep`` beside them.

    A file appears by one rename: a task that is run again replaces it by the same bytes.
    """
    top = unquote(folder.removeprefix("file://").removeprefix("file:"))
    if "://" in top:
        raise ValueError(f"clips need a mounted shared folder, not {folder}")
    ship(rows.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(top, exist_ok=True)
        for f in frames:
            paths = [f"{top}/{name}" for name in f["name"]]
            for p, content in zip(paths, f["content"], strict=True):
                own = f"{p}.{uuid.uuid4().hex}.tmp"
                with open(own, "wb") as out:
                    out.write(content)
                os.replace(own, p)
            yield pd.DataFrame({"path": paths, "size": [len(c) for c in f["content"]]} | {f"kept_{k}": f[f"kept_{k}"] for k in keep})

    kept = [F.col(k).alias(f"kept_{k}") for k in keep]
    types = "".join(f", kept_{k} {rows.schema[k].dataType.simpleString()}" for k in keep)
    files = rows.select("name", "content", *kept).mapInPandas(run, "path string, size long" + types)
    # path is the file's; a kept column of that name is the row's own
    return files.select(*(["path"] if "path" not in keep else []), "size", *(F.col(f"kept_{k}").alias(k) for k in keep))
