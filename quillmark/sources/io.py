"""Readers with fixed schemas and writers."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from itertools import groupby
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.json import stt_segments
from ..functions.metrics import grade
from ..functions.text import strip, tokens
from ..functions.edit import error_rate, word_distance
from ..shared import staged
from ..ship import ship

GROUND_TRUTH = "audio_path string, reference_text string, original_audio string, is_augmented boolean"
LADDER = "transcript string, quality_score int, wer double, label string"
CALIBRATION = "predictions array<int>, labels array<int>, confidences array<double>"


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of items, one a file; absent lineage means an original."""
    df = spark.read.schema(GROUND_TRUTH).option("multiLine", True).json(path)
    return df.withColumn("is_augmented", F.coalesce("is_augmented", F.lit(False))).withColumn("original_audio", F.coalesce("original_audio", "audio_path"))


def ladder(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LADDER).option("multiLine", True).json(path)


def stt_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """file, pos, start_ts, end_ts, transcript, speaker of every ``*.json`` reply of a folder (and of those in it)."""
    files = spark.read.option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).text(folder, wholetext=True).withColumn("file", F.input_file_name())
    rows = files.select("file", F.posexplode(stt_segments(F.col("value"))).alias("pos", "s"))
    return rows.select("file", "pos", "s.*")


def named_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """name (without folder and extension), text of whole files."""
    files = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(folder, wholetext=True)
    return files.select(F.regexp_extract(F.input_file_name(), r"([^/]*?)(?:\.[^./]*)?$", 1).alias("name"), F.col("value").alias("text"))


def named_texts(spark: SparkSession, path: str) -> DataFrame:
    """The same of files that hold many texts: a JSON object of name and text a line."""
    return spark.read.schema("name string, text string").json(path)


def stt_with_reference(replies: DataFrame, references: DataFrame) -> DataFrame:
    """name, transcript, transcript_data (the reply), reference: replies and whole references (name, text both) paired by name.

    A reply without a reference, or the other way round, is left out. Files may be one a recording or hold very many.
    """
    reply = replies.select("name", F.get_json_object("text", "$.transcript").alias("transcript"), F.col("text").alias("transcript_data"))
    return reply.join(references.select("name", strip(F.col("text")).alias("reference")), "name")


def audio_files(spark: SparkSession, samples: DataFrame, folder: str, extensions=("mp3", "wav", "m4a")) -> DataFrame:
    """``samples`` (sample_id) with audio_path: the first of ``sample_{id}.{extension}`` that exists, else null."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "sample_*").load(folder).select("path")
    name = F.regexp_extract("path", r"sample_(\d+)\.([A-Za-z0-9]+)$", 1)
    order = F.array_position(F.array(*map(F.lit, extensions)), F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)))
    best = files.select(name.try_cast("long").alias("sample_id"), "path", order.alias("o")).where("o > 0 and sample_id is not null").groupBy("sample_id").agg(F.min_by("path", "o").alias("audio_path"))
    return samples.join(best, "sample_id", "left")


def training_samples(samples: DataFrame) -> DataFrame:
    """With quality_score: the grade of the error rate of ``transcript`` against ``reference``; 3 where either is missing."""
    ref, hyp = tokens("reference"), tokens("transcript")
    rate = F.when(F.col("reference").isNotNull() & F.col("transcript").isNotNull(), error_rate(word_distance(ref, hyp), F.size(ref), F.size(hyp)))
    return samples.withColumn("quality_score", grade(rate))


def calibration_pairs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """prediction, label, confidence rows of payloads of three parallel arrays: one a file, or one a line."""
    rows = spark.read.schema(CALIBRATION).option("multiLine", not lines).json(path).select(F.explode(F.arrays_zip("predictions", "labels", "confidences")).alias("x"))
    return rows.select(F.col("x.predictions").alias("prediction"), F.col("x.labels").alias("label"), F.col("x.confidences").alias("confidence"))


def write_calibration(df: DataFrame, path: str, rows: int = 10_000) -> None:
    """Payloads of three parallel arrays from prediction, label and confidence, a line for each ``rows`` rows at most."""
    numbered = df.select("prediction", "label", "confidence", F.monotonically_increasing_id().alias("id")).withColumn("part", F.expr(f"id div {rows}"))
    all_of = F.array_sort(F.collect_list(F.struct("id", "prediction", "label", "confidence")))  # ``rows`` at most
    out = numbered.groupBy("part").agg(all_of.alias("x"))
    out.select(F.col("x.prediction").alias("predictions"), F.col("x.label").alias("labels"), F.col("x.confidence").alias("confidences")).write.mode("overwrite").json(path)


def write_results(df: DataFrame, path: str) -> None:
    """JSON lines, in as many files as partitions."""
    df.write.mode("overwrite").json(path)


def write_array(df: DataFrame, path: str) -> None:
    """Each file one JSON array with an item per row; characters are written as they are. Rows are streamed, not gathered."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = "["
        for b in batches:
            items = []
            for x in b.column(0).to_pylist():
                items.append(lead + x)
                lead = ","
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]" if lead == "," else "[]"])], names=["value"])

    df.select(F.to_json(F.struct(*(f"`{c}`" for c in df.columns))).alias("value")).mapInArrow(run, "value string").write.mode("overwrite").text(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    """The non-empty texts as text files, a line each, in as many files as partitions."""
    df.select(column).where(F.length(column) > 0).write.mode("overwrite").text(path)


def write_one_text(df: DataFrame, column: str, path: str, order: list[str]) -> int:
    """One file of the non-empty texts in order, each with a line's end; its size in bytes.

    No task has more than its range of the order: ranges are staged, their bytes summed up, and each is written at its own place of
    a file of the full size, which gets its name when all are there. A task that runs again writes the same bytes to the same place.
    The folder must be mounted everywhere. Equal places in the order follow their texts.
    """
    spark = df.sparkSession
    ship(spark)
    if "://" in path.removeprefix("file://"):
        raise ValueError(f"one file needs a mounted shared folder, not {path}")
    top = unquote(path.removeprefix("file://").removeprefix("file:"))
    keys = [f"order_{i}" for i in range(len(order))]
    rows = df.where(F.length(column) > 0).select(*(F.col(o).alias(k) for o, k in zip(order, keys, strict=True)), F.col(column).cast("string").alias("line"))
    rows = staged(rows.repartitionByRange(*keys, "line").withColumn("part", F.spark_partition_id()), "one-text")
    bases, size = {}, 0
    for r in rows.groupBy("part").agg(F.sum(F.octet_length("line") + 1).alias("n")).orderBy("part").collect():  # a row per task
        bases[r.part], size = size, size + r.n
    part = f"{top}.{uuid.uuid4().hex}.part"
    os.makedirs(os.path.dirname(top), exist_ok=True)
    with open(part, "wb") as f:
        f.truncate(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[int, int] = {}
        file = os.open(part, os.O_WRONLY)
        try:
            for b in batches:
                numbers, lines = b.column("part").to_pylist(), b.column("line").to_pylist()
                for k, own in groupby(range(b.num_rows), numbers.__getitem__):
                    data = "".join(lines[i] + "\n" for i in own).encode()
                    start = at.get(k, bases[k])
                    at[k] = start + len(data)
                    while data:
                        done = os.pwrite(file, data, start)
                        data, start = data[done:], start + done
        finally:
            os.close(file)
        yield pa.RecordBatch.from_arrays([pa.array([sum(v - bases[k] for k, v in at.items())], pa.int64())], names=["size"])

    parts = rows.repartition("part").sortWithinPartitions("part", *keys, "line").select("part", "line")
    written = parts.mapInArrow(run, "size long").agg(F.sum("size")).first()[0] or 0
    if written != size:
        raise OSError(f"{written} of {size} bytes written")
    os.replace(part, top)
    return size


def combined(original: DataFrame, augmented: DataFrame) -> DataFrame:
    """Original items, then augmented ones, with their lineage."""
    out = original.unionByName(augmented, allowMissingColumns=True)
    return out.withColumn("is_augmented", F.coalesce("is_augmented", F.lit(False))) if "is_augmented" in out.columns else out
