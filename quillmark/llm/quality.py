"""Quality rules: word rules, then a hashed n-gram log-likelihood ratio of trusted target against raw corpus.

N-grams are byte n-grams, hashed to a fixed number of buckets; the target multinomial counts the trusted documents, the raw
one every document. A document's ratio is the sum over its n-grams of log p(target) - log p(raw), over its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common, words

ORDERS, BUCKETS, SMOOTH = (3, 4), 1 << 16, 1.0
#: Added to a text's n-grams when its ratio is divided by them; share of trusted documents that the threshold may lose;
#: step of the grid that the threshold is taken from.
SHRINK, LOSE, GRID = 64, 0.004, 1000

#: Trusted ids of a block, about. A block is broadcast, so that no text is shuffled; each block more is a pass over the texts
#: that counts that block's documents alone.
BLOCK = 1_000_000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _ngrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, doc) of each byte n-gram, none across documents."""
    buckets, docs = [], []
    of = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))
    b = data.astype(np.uint64)
    for n in ORDERS:
        m = len(data) - n + 1
        if m <= 0:
            continue
        code = np.full(m, n, np.uint64)
        for k in range(n):
            code = code * np.uint64(257) + b[k : m + k]
        same = of[:m] == of[n - 1 :]
        code = code[same] * np.uint64(0x9E3779B97F4A7C15)
        buckets.append((code >> np.uint64(48)).astype(np.int64) % BUCKETS)
        docs.append(of[:m][same])
    return (np.concatenate(buckets), np.concatenate(docs)) if buckets else (np.zeros(0, np.int64), np.zeros(0, np.int32))


def counts(rows: DataFrame) -> np.ndarray:
    """Target and raw counts of the buckets from (text, trusted): two lines of a fixed length, summed from one pair per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            trusted = np.array([bool(x) for x in b.column(1).to_pylist()])
            for at, data, off in words.chunks(b.column(0)):
                bucket, doc = _ngrams(data, off)
                total[1] += np.bincount(bucket, minlength=BUCKETS)
                total[0] += np.bincount(bucket[trusted[at : at + len(off) - 1][doc]], minlength=BUCKETS)
        if total.any():
            yield pa.RecordBatch.from_pydict({"bucket": np.arange(BUCKETS), "target": total[0], "raw": total[1]})

    parts = rows.mapInArrow(run, "bucket long, target long, raw long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))
    out = np.zeros((2, BUCKETS))
    for r in parts.collect():  # BUCKETS rows at most
        out[:, r.bucket] = r.target, r.raw
    return out


def weights(both: np.ndarray) -> np.ndarray:
    p = (both + SMOOTH) / (both.sum(1, keepdims=True) + SMOOTH * BUCKETS)
    return np.log(p[0]) - np.log(p[1])


def _rules(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text of a chunk."""
    docs = len(off) - 1
    w = words.Words(data, off)
    n_words = np.diff(w.bounds)
    of = np.repeat(np.arange(docs), np.diff(off))
    lead = (data & 0xC0) != 0x80
    word_chars = np.bincount(of[lead & ~words.SPACE[data]], minlength=docs)
    symbols = np.bincount(of[_SYMBOL[data]], minlength=docs)
    h = w.hashes()
    repeats = np.zeros(docs, np.int64)
    if len(h) >= 8:
        s = words.shingles(h, 8)
        same = w.doc[: len(s)] == w.doc[7:]
        place = np.flatnonzero(same)
        key = words.mix(s[place] + w.doc[place].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        eq = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][eq]] = True
        twice[order[:-1][eq]] = True
        edge = np.zeros(len(h) + 8, np.int64)
        np.add.at(edge, place[twice], 1)
        np.add.at(edge, place[twice] + 8, -1)
        repeats = np.bincount(w.doc[np.cumsum(edge)[: len(h)] > 0], minlength=docs)
    dup = np.zeros(docs, np.int64)
    raw = data.tobytes()
    for d in range(docs):
        if n_words[d]:
            seen: set[bytes] = set()
            for line in raw[off[d] : off[d + 1]].split(b"\n"):
                if line in seen:
                    dup[d] += 1
                elif line.strip(b" \t\n\x0b\x0c\r"):
                    seen.add(line)
    return [n_words, word_chars, symbols, dup, repeats]


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, weight: np.ndarray) -> DataFrame:
    schema = "doc_id long, " + ", ".join(f"{n} long" for n in NAMES) + ", llr double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, data, off in words.chunks(b.column(1)):
                cols = _rules(data, off)
                bucket, doc = _ngrams(data, off)
                total = np.bincount(doc, weight[bucket], minlength=len(off) - 1)
                llr = total / (np.bincount(doc, minlength=len(off) - 1) + SHRINK)
                yield pa.RecordBatch.from_pydict({"doc_id": b.column(0).slice(at, len(off) - 1), **{n: pa.array(c.astype(np.int64)) for n, c in zip(NAMES, cols, strict=True)}, "llr": pa.array(llr)})

    return docs.mapInArrow(run, schema)


def quality_filter(docs: DataFrame, trusted: DataFrame, id_col="doc_id", text_col="text", lose: float = LOSE, block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept.

    ``trusted``: ids of the trusted target. The threshold is the grid value below which at most the share ``lose`` of the
    trusted documents that pass the word rules lies; without any, everything that passes is kept. Null text counts as
    empty; a text without n-grams has ratio 0; texts are read whole, however long; a ratio that ties with the threshold is kept;
    repeated rows and ids give a row each (of a trusted id, all count); extra columns are ignored, whatever their names; an
    empty table gives no rows.
    """
    common.ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ids = trusted.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("trusted", F.lit(True))
    blocks = max(1, -(-ids.count() // block))
    both = np.zeros((2, BUCKETS))
    for k in range(blocks):
        target = F.broadcast(ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == k))  # about ``block`` ids
        found = counts(rows.join(target, "doc_id", "inner" if k else "left").select("text", "trusted"))
        both[0] += found[0]
        if not k:  # the first pass has every document
            both[1] = found[1]
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    scored = common.staged(measured(rows, weights(both)).withColumn("base_failed", failed), "quality")
    grid = scored.where("not base_failed").join(ids, "doc_id").groupBy(F.floor(F.col("llr") * GRID).alias("g")).count().orderBy("g").collect()
    allowed, threshold, seen = lose * sum(r["count"] for r in grid), None, 0  # the grid has as many rows as steps between two log ratios
    for r in grid:
        seen += r["count"]
        if seen > allowed:
            threshold = r["g"] / GRID
            break
    kept = ~F.col("base_failed") & (F.lit(True) if threshold is None else F.col("llr") >= F.lit(threshold))
    return scored.withColumn("kept", kept)
