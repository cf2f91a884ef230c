"""A training corpus from ``documents``: each stage is written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillmark.llm import common, exact_dedup, mixing, near_join, packing, queries, tokens, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the toxicity threshold; the model learns from labelled rows of the stage's input.

    Null and empty texts score as such, long ones whole; repeated rows stay or go alike; without labels of both classes every
    score is the share of toxic rows; an empty table stays empty. Extra columns stay, whatever their names.
    """
    labels = common.table(spark, sf_dir, "labels").where(toxicity.fold(F.col("doc_id"), 4) != 2)
    return toxicity.non_toxic(docs, toxicity.fit(docs, labels))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (but for A-Z's case; null is empty) the one with the largest id; of rows that repeat its id
    one stays. Long texts are compared whole; an empty table stays empty. Extra columns stay, whatever their names.
    """
    return exact_dedup.survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 or more of their five-word shingles): the one with the smallest id.

    Null, empty and wordless texts are in no group and stay, as rows without an id do; all rows of an id stay or go together; an
    empty table stays empty. Extra columns stay, whatever their names.
    """
    groups = near_join.near_groups(docs, shingle=5, num=80, den=100)
    (gone,) = common.fresh(docs.columns, "gone")
    dropped = common.staged(groups.where("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct(), "pipeline-near-copies")
    return docs.join(dropped, docs["doc_id"] == dropped[gone], "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy that the mix takes, in training order; a copy that is cut has the shorter text (and its ``n_chars``).

    Null and empty texts are never taken; a null source is one of its own; equal rows are taken as often as each; an empty table
    stays empty. Extra columns stay, whatever their names.
    """
    mixed = mixing.mixed_documents(docs)
    # a copy that is cut is shorter than its document
    return mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else mixed


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all copies in windows of tokens: null and empty texts are an end id, each copy is packed by itself, an empty
    table gives no pieces; extra columns are ignored.
    """
    return packing.pack_documents(docs, tokens.tokenizer_path(queries.WORD_BPE), queries.END)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: SQL can't express compression lengths, tokenizers or retrieval packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
