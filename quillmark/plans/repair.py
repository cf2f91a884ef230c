"""Transcript repair and translation: chunks are annotated and joined again in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.edit import overlap_words
from ..functions.text import chunks, fragments, tokens
from ..operators.annotate import annotate


def _annotated(df: DataFrame, key: str, parts, backend) -> DataFrame:
    """(key, pos, fixed): a row per chunk with the backend's text; a chunk that failed passes through."""
    rows = df.select(key, F.posexplode(parts).alias("pos", "chunk"))
    done = annotate(rows, "chunk", backend, "fixed")
    return done.select(key, "pos", F.when(F.length(F.coalesce("fixed", F.lit(""))) > 0, F.col("fixed")).otherwise(F.col("chunk")).alias("fixed"))


def _joined(df: DataFrame, key: str, done: DataFrame, out: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("pos", "fixed")))
    joined = done.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["fixed"]), " ").alias(out))
    return df.join(joined, key, "left").withColumn(out, F.coalesce(out, F.lit("")))


def _chunked(df: DataFrame, key: str, parts, backend, out: str) -> DataFrame:
    return _joined(df, key, _annotated(df, key, parts, backend), out)


def merged(done: DataFrame, key: str, overlap: int) -> DataFrame:
    """(key, pos, fixed) without the words at a chunk's beginning that the chunk before ends with, found by content: an annotator may
    have changed some of them, or their number by a quarter. Chunks that nothing is left of are gone."""
    reach = overlap + max(overlap // 4, 1)
    rows = done.withColumn("w", tokens("fixed"))
    tail = F.slice("w", F.greatest(F.size("w") - reach, F.lit(0)) + 1, F.lit(reach))
    rows = rows.withColumn("tail", F.lag(tail).over(W.partitionBy(key).orderBy("pos"))).withColumn("head", F.slice("w", 1, reach))
    low = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), F.lower)
    rows = rows.withColumn("n", overlap_words(low("tail"), low("head"), overlap).cast("int"))
    return rows.select(key, "pos", F.array_join(F.slice("w", F.col("n") + 1, F.size("w")), " ").alias("fixed")).where("fixed <> ''")


def repair(df: DataFrame, key: str, text: str, backend, out: str = "repaired", size: int = 200, overlap: int = 20, dedup_overlap: bool = False) -> DataFrame:
    """Word chunks with an overlap, which stays in the joined text unless ``dedup_overlap``: then what a chunk repeats of the one before
    is found by content and left out."""
    done = _annotated(df, key, chunks(tokens(F.col(text)), size, size - overlap), backend)
    return _joined(df, key, merged(done, key, overlap) if dedup_overlap else done, out)


def translate(df: DataFrame, key: str, text: str, backend, out: str = "translated", size: int = 10) -> DataFrame:
    """Chunks of ``size`` sentence fragments."""
    return _chunked(df, key, chunks(fragments(F.col(text)), size), backend, out)
