"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text, one on windows around what toxic texts say more often than
ordinary ones. Every window of a text is compressed with the ordinary dictionary alone and with the toxic one before it; the
bytes saved are its gain. How many windows reach each gain, out of how many, is calibrated to a probability on labelled rows
that the dictionaries were not trained on.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import caches, common

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGES = ".,;:!?\"'()[]"

#: Bounds of the labelled sample that is fitted: rows of each class, and characters of a row (longer rows aren't used).
MAX_TOXIC, MAX_ORDINARY, MAX_CHARS = 4000, 8000, 8000
#: Bytes of the dictionaries; the constant text around a window, which makes the coder write sequences for short windows.
TOXIC_BYTES, ORDINARY_BYTES, CARRIER = 8192, 16384, b"0123456789ab"
#: Windows of a worker's memory; more are compressed each time they come.
CACHE_WINDOWS = 400_000
GAINS = (2, 3, 4, 5, 6)


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    weight: np.ndarray | None = None
    prior: float = 0.0


class Gains:
    """Bytes saved per window, remembered per process and model until a task ends."""

    _of: dict[tuple[int, int], "Gains"] = {}

    def __init__(self, model: Model):
        import zstandard as zs

        par = zs.ZstdCompressionParameters(format=zs.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0, compression_level=1)

        def compressor(content: bytes):
            d = zs.ZstdCompressionDict(content + CARRIER, dict_type=zs.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=par)
            return zs.ZstdCompressor(dict_data=d, compression_params=par).compress

        self.with_toxic, self.plain = compressor(model.toxic + model.ordinary), compressor(model.ordinary)
        self.known: dict[str, int] = {}

    @classmethod
    def of(cls, model: Model) -> "Gains":
        caches.claim("toxicity", cls._of.clear)
        key = (hash(model.toxic), hash(model.ordinary))
        if key not in cls._of:
            cls._of.clear()
            cls._of[key] = cls(model)
        return cls._of[key]

    @classmethod
    def release(cls) -> None:
        """At a task's end: the worker waits with little memory, whatever comes next."""
        cls._of.clear()
        caches.give_back()

    def gain(self, window: str) -> int:
        g = self.known.get(window)
        if g is None:
            x = CARRIER + b" " + window.encode("utf-8", "replace") + b" " + CARRIER
            g = len(self.plain(x)) - len(self.with_toxic(x))
            if len(self.known) < CACHE_WINDOWS and len(window) <= 40:
                self.known[window] = g
        return g

    def features(self, text: str | None) -> list[float]:
        gains = np.fromiter(map(self.gain, windows(text)), np.int64)
        n, top = len(gains), int(gains.max()) if len(gains) else 0
        c = [int((gains >= k).sum()) for k in GAINS]
        return [min(top, 8), *np.log1p(c), *np.log((np.array(c) + 0.2) / (n + 10)), np.log1p(n)]


def windows(text: str | None) -> list[str]:
    """The windows of a text: its words in lower case, without marks at their ends."""
    return [w.strip(_EDGES) for w in _WORD.findall((text or "").lower())]


def _grams(words: set[str]) -> set[str]:
    return {w[i : i + n] for w in words for n in range(4, 9) for i in range(len(w) - n + 1)}


def train_dictionaries(toxic: list[str], ordinary: list[str]) -> Model:
    """Dictionaries from two lists of texts. Too little text to train on gives its own bytes, cut to the dictionary's size."""
    import zstandard as zs

    def train(size: int, samples: list[bytes]) -> bytes:
        try:
            return zs.train_dictionary(size, samples).as_bytes()
        except zs.ZstdError:
            return b"".join(samples)[:size]

    n_t, n_o = max(1, len(toxic)), max(1, len(ordinary))
    least, marked = max(2, n_t // 75), set()
    in_t, in_o = Counter(), Counter()  # of one text at a time: the driver holds no list of all windows
    for t in toxic:
        in_t.update(_grams(set(windows(t))))
    in_t = {g: a for g, a in in_t.items() if a >= least}
    for t in ordinary:
        in_o.update(g for g in _grams(set(windows(t))) if g in in_t)
    for g, a in in_t.items():
        b = in_o.get(g, 0)
        p = (a + b) / (n_t + n_o)
        z = (a / n_t - b / n_o) / np.sqrt(p * (1 - p) * (1 / n_t + 1 / n_o) + 1e-12)
        if z > 8 and np.log((a + 0.5) / (n_t + 1)) - np.log((b + 0.5) / (n_o + 1)) > 1.5:
            marked.add(g)
    del in_t, in_o
    picks = [f" {w} ".encode() for t in toxic for w in windows(t) if not marked.isdisjoint(_grams({w}))]
    plain = (w.encode() for t in ordinary for w in windows(t))
    return Model(train(TOXIC_BYTES, [b"".join(picks[i : i + 8]) for i in range(0, len(picks), 8)]), train(ORDINARY_BYTES, [b" ".join(x) for x in batched(plain, 8)]))


def calibrate(model: Model, texts: list[str], labels: list[int]) -> Model:
    """Logistic weights of the gain features by Newton's method with a small ridge."""
    y = np.array(labels, float)
    model.prior = float(y.mean()) if len(y) else 0.0
    if not 0 < y.sum() < len(y):
        return model
    g = Gains(model)
    x = np.array([g.features(t) for t in texts])
    del g
    model.mean, model.spread = x.mean(0), x.std(0) + 1e-9
    a = np.c_[np.ones(len(x)), (x - model.mean) / model.spread]
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(w)), a.T @ (p - y) + 1e-2 * w)
    model.weight = w
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", max_toxic=MAX_TOXIC, max_ordinary=MAX_ORDINARY, max_chars=MAX_CHARS) -> Model:
    """Fit on at most ``max_toxic`` + ``max_ordinary`` labelled rows, the first by a hash of their id.

    A quarter of them is kept for calibration. Rows without label, id or text aren't used; an id with both labels counts as
    toxic; rows that repeat an id are each used; without rows of both classes every score is the share of toxic rows.
    """
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"), F.xxhash64(F.col(id_col).cast("string"), F.lit("toxicity")).alias("h"))
    parts = []
    for y, most in ((1, max_toxic), (0, max_ordinary)):
        own = marks.where(F.col("y") == y)
        # low hashes only, so that no task sends ``most`` rows to the driver; half as many more leave room for chance
        share = int(min(1.0, (1.5 * most + 50) / max(1, own.count())) * (1 << 32))
        parts.append(own.where(F.pmod("h", F.lit(1 << 32)) < share).orderBy("h", "id").limit(most))
    # at most max_toxic + max_ordinary rows of three numbers
    chosen = F.broadcast(parts[0].unionByName(parts[1]).groupBy("id").agg(F.max("y").alias("y"), F.min("h").alias("h")))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") <= max_chars).join(chosen, "id").collect()
    rows = sorted({(r.h, r.id, r.y, r.text) for r in rows})
    held = [r for r in rows if r[0] % 4 == 0]
    used = [r for r in rows if r[0] % 4]
    model = train_dictionaries([r[3] for r in used if r[2]], [r[3] for r in used if not r[2]])
    return calibrate(model, [r[3] for r in held], [r[2] for r in held])


def probabilities(model: Model, texts: pa.Array) -> np.ndarray:
    if model.weight is None:
        return np.full(len(texts), model.prior)
    g = Gains.of(model)
    x = np.array([g.features(t.as_py()) for t in texts]).reshape(len(texts), len(model.mean))
    return 1 / (1 + np.exp(-np.clip(np.c_[np.ones(len(x)), (x - model.mean) / model.spread] @ model.weight, -30, 30)))


def score(docs: DataFrame, model: Model, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per input row: doc_id, score (0..1).

    Null or empty text has no windows and scores as such; texts are read whole, however long; repeated rows and ids give a row
    each; extra columns are ignored, whatever their names; an empty table gives no rows. No order matters. Rows are worked on by
    themselves: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(probabilities(model, b.column(1)))], names=["doc_id", "score"])
        Gains.release()

    common.ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def non_toxic(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, with all their columns, whatever their names: no shuffle."""
    common.ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(probabilities(model, b.column(at)) < threshold))
        Gains.release()

    return docs.mapInArrow(run, docs.schema)


def fold(id_col: Column, n: int) -> Column:
    return F.crc32(id_col.cast("string")) % n
