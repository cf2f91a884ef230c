"""What each filter removes in every order of the filters, by part: first failures looked up in a table of masks by orders."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from . import common

LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]
STEPS = len(LETTERS)

#: FIRST[mask, order]: the step (0 to 4) at which a document that fails the filters of ``mask`` goes, 5 if it stays.
FIRST = np.array([[min((k for k, c in enumerate(o) if mask >> LETTERS.index(c) & 1), default=STEPS) for o in ORDERS] for mask in range(1 << STEPS)], np.int64)

#: Rows looked up at once and parts held at once: 120 steps a row, 2,160 counts a part.
ROWS, PARTS = 4096, 1024

TALLY = "part string, order_no int, step int, removed long, good_lost long, toxic_lost long"


def text_failures(text) -> list:
    """Filters A to D of a text (null counts as empty): under 50 words, under 65% distinct words, over 5% capitals, a symbol."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(common.WORD), F.lit(0))
    few = lambda w: F.struct((F.size(w) < 50).alias("a"), (100 * F.size(F.array_distinct(w)) < 65 * F.size(w)).alias("b"))
    ab = F.transform(F.array(words), few)[0]
    return [ab["a"], ab["b"], 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text), text.rlike("[#$%&*|]")]


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic: a light row per document; bit k of ``mask`` is set where it fails filter k.

    Filter E fails a document whose text a smaller doc_id has, removed or not; texts of one SHA-256 are taken for identical. Of the
    texts only digests are shuffled; a text that many rows have is joined by ``join_hot``. Null texts are empty, a null source is
    the part '', a null doc_id is smaller than none and has no label, rows of one doc_id and text are no copies of each other. A
    document with several labels counts as good (toxic) if one of them says so.
    """
    bits = F.lit(0)
    for k, failed in enumerate(text_failures(F.col("text"))):
        bits = bits + F.when(failed, 1 << k).otherwise(0)
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), bits.alias("mask"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"))
    rows = common.staged(rows, "audit-rows")
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(*(F.max(F.coalesce(F.col(a) == 1, F.lit(False))).alias(b) for a, b in (("quality", "good"), ("toxic", "toxic"))))
    rows = rows.join(marks.hint("merge"), "doc_id", "left")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    rows = common.join_hot(rows, common.staged(first, "audit-copies"), ["digest"], "copies", rows.count(), "left")
    copy = F.when(F.col("doc_id") > F.col("first_id"), 1 << 4).otherwise(0)
    return rows.select("part", (F.col("mask") + copy).cast("int").alias("mask"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))


def _rows(parts: list[str], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The counts of parts as rows, zeros too."""
    size = len(ORDERS) * (STEPS + 1)
    for at in range(0, len(parts), 64):
        own, n = parts[at : at + 64], len(parts[at : at + 64])
        no = np.tile(np.arange(size), n)
        cols = [np.repeat(np.array(own, object), size), (no // (STEPS + 1)).astype(np.int32), (no % (STEPS + 1) + 1).astype(np.int32), *counts[:, at : at + n].reshape(3, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[c.split()[0] for c in TALLY.split(", ")])


def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removals by part, order and step (6: kept), of all documents, good ones and toxic ones. Parts are let go at ``PARTS``."""
    size = len(ORDERS) * (STEPS + 1)
    cell = np.arange(len(ORDERS)) * (STEPS + 1) + FIRST
    held: dict[str, int] = {}
    counts = np.zeros((3, 0, size), np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            b = batch.slice(at, ROWS)
            part = b.column("part").dictionary_encode()
            names, codes = part.dictionary.to_pylist(), part.indices.to_numpy()
            if held and len(held) + sum(n not in held for n in names) > PARTS:
                yield from _rows(list(held), counts)
                held, counts = {}, np.zeros((3, 0, size), np.int64)
            for n in names:
                held.setdefault(n, len(held))
            counts = np.concatenate([counts, np.zeros((3, len(held) - counts.shape[1], size), np.int64)], 1)
            keys = codes[:, None] * size + cell[b.column("mask").to_numpy()]
            place = [held[n] for n in names]
            for k, rows in enumerate((slice(None), *(b.column(c).to_numpy(zero_copy_only=False) for c in ("good", "toxic")))):
                counts[k, place] += np.bincount(keys[rows].ravel(), minlength=len(names) * size).reshape(len(names), size)
    yield from _rows(list(held), counts)


def audit(rows: DataFrame) -> DataFrame:
    """``rows`` (part, mask, good, toxic) as one row per part, order and step.

    The first step of an order removes all that fail its filter and the last one those that fail nothing else: ``redundant`` and
    ``unique_fails`` are taken from there. Without rows there are no parts and no result.
    """
    common.ship(rows.sparkSession)
    sums = rows.mapInArrow(tally, TALLY).groupBy("part", "order_no", "step").agg(*(F.sum(c).alias(c) for c in ("removed", "good_lost", "toxic_lost")))
    name = F.element_at(F.array(*map(F.lit, ORDERS)), F.col("order_no") + 1)
    sums = sums.withColumn("filter_order", name).withColumn("letter", F.substring(name, F.col("step"), F.lit(1)))
    rest = W.partitionBy("part", "order_no").orderBy("step").rowsBetween(1, W.unboundedFollowing)
    one = W.partitionBy("part", "letter")
    at = lambda k: F.max(F.when(F.col("step") == k, F.col("removed"))).over(one)
    sums = sums.withColumn("kept", F.coalesce(F.sum("removed").over(rest), F.lit(0))).where(f"step <= {STEPS}")
    return sums.select(
        "part", "filter_order", "step", "kept", "removed", (at(1) - F.col("removed")).alias("redundant"), at(STEPS).alias("unique_fails"), "good_lost", "toxic_lost", F.sum("removed").over(one).alias("shapley")
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E over ``docs`` (doc_id, text, source) with ``labels`` (doc_id, quality, toxic); see ``failures``.

    Other columns aren't looked at, whatever their names. Empty labels lose nothing good or toxic; an empty table gives no rows.
    """
    return audit(failures(docs, labels))
