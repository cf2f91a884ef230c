"""Exact dedup over an extendible-hash index on shared files. DataFrame functions only.

Every text gets a 64-bit key; the leading bits of a key are its slot in the directory. The directory doubles (one bit more)
as long as a slot has more than ``bucket_entries`` distinct keys. A bucket is the longest run of slots with a common prefix
that isn't overfull; its prefix's length is its local depth. Slots of one bucket point to it. The index has an entry per key,
under its bucket, in files sorted by bucket and key, so that each owner task has a range of keys. Rows look up their bucket
in the directory and their key in the bucket. Entries that more than one row collides on are chained by comparing the bytes
of the texts themselves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from . import common


#: Local depths that a directory tells apart, from its own depth down; slots of a directory that is broadcast, at most.
LEVELS, BROADCAST_SLOTS = 8, 1 << 16


def key_of(text: Column, key_bits: int = 64) -> Column:
    return F.shiftrightunsigned(F.xxhash64(text), 64 - key_bits) if key_bits < 64 else F.xxhash64(text)


def slot_of(key: Column, depth: int, key_bits: int = 64) -> Column:
    """The ``depth`` leading bits of a key."""
    return F.shiftrightunsigned(key, key_bits - depth) if depth else F.lit(0).cast("long")


def entries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bits: int = 64) -> DataFrame:
    """doc_id, row_id, key, text_sha256 of every row."""
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), common.lower_ascii(F.col(text_col)).alias("text"))
    return rows.select("doc_id", F.monotonically_increasing_id().alias("row_id"), key_of(text, key_bits).alias("key"), F.sha2("text", 256).alias("text_sha256"))


def directory(keys: DataFrame, bucket_entries: int, key_bits: int = 64) -> tuple[DataFrame, int]:
    """(slot, local_depth, bucket), one row per slot that has keys, and the directory's depth. keys: key, distinct."""
    total = keys.count()
    depth = min(key_bits, max(0, math.ceil(math.log2(max(1, total) / bucket_entries)) + 1))
    while True:
        slots = keys.groupBy(slot_of(F.col("key"), depth, key_bits).alias("slot")).agg(F.count(F.lit(1)).alias("entries"))
        if depth == key_bits or slots.where(F.col("entries") > bucket_entries).isEmpty():
            break
        depth += 1  # the directory doubles; at the key's last bit a bucket can only grow
    slots = common.staged(slots, "dedup-slots")
    # every prefix of a slot, its longest first; a bucket's number is its prefix filled up to the directory's depth
    at = slots.withColumn("cut", F.explode(F.sequence(F.lit(0), F.lit(min(depth, LEVELS)))))
    at = at.withColumn("bucket", F.expr("shiftleft(shiftright(slot, cut), cut)"))
    full = at.groupBy("cut", "bucket").agg(F.sum("entries").alias("held"))
    fits = full.where((F.col("held") <= bucket_entries) | (F.col("cut") == 0))
    found = at.join(fits, ["cut", "bucket"]).groupBy("slot").agg(F.max(F.struct("cut", "bucket")).alias("b"))
    return common.staged(found.select("slot", (F.lit(depth) - F.col("b.cut")).alias("local_depth"), F.col("b.bucket").alias("bucket")), "dedup-directory"), depth


def located(rows: DataFrame, found: DataFrame, depth: int, key_bits: int = 64) -> DataFrame:
    """Rows (key, ...) with the bucket that the directory has for their slot."""
    slots = found.select("slot", "bucket")
    if depth <= int(math.log2(BROADCAST_SLOTS)):  # at most 2**depth rows
        slots = F.broadcast(slots)
    return rows.withColumn("slot", slot_of(F.col("key"), depth, key_bits)).join(slots, "slot").drop("slot")


def build_index(rows: DataFrame, bucket_entries: int = 4096, key_bits: int = 64) -> tuple[DataFrame, DataFrame, int]:
    """The index on shared files (bucket, key, rows), its directory and the directory's depth. rows: key, repeated."""
    keys = common.staged(rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows")), "dedup-keys")
    found, depth = directory(keys.select("key"), bucket_entries, key_bits)
    index = located(keys, found, depth, key_bits).repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key")
    return common.staged(index, "dedup-index"), found, depth


def extendible_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_entries: int = 4096, key_bits: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; texts are equal when identical after lower-casing A-Z, and are compared whole, however long. The
    row with the largest doc_id stays (null ids come last; of rows that tie on that id one stays). Extra columns are ignored,
    whatever their names; an empty table gives no rows. ``key_bits`` below 64 only serves to provoke collisions in tests.
    """
    rows = common.staged(entries(docs, id_col, text_col, key_bits), "dedup-entries")
    index, slots, depth = build_index(rows, bucket_entries, key_bits)
    total = rows.count()
    shared = index.where("rows > 1")  # entries with a chain
    at = ["bucket", "key"]
    # a text's bucket and entry are looked up; in an entry, bytes are compared: it falls apart into chains of equal texts
    text = common.lower_ascii(F.col(text_col))
    texts = located(docs.select(text.alias("text")).withColumn("key", key_of(F.col("text"), key_bits)), slots, depth, key_bits)
    chains = common.join_hot(texts, shared, at, "rows", total).groupBy(*at, "text").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chains = chains.select(*at, F.sha2("text", 256).alias("text_sha256"), "n")
    own = located(rows, slots, depth, key_bits)
    tops = common.join_hot(own, shared, at, "rows", total).groupBy(*at, "text_sha256").agg(F.max(F.struct("doc_id", "row_id")).alias("top"))
    chains = common.staged(chains.join(tops, [*at, "text_sha256"]), "dedup-chains")
    out = common.join_hot(own, chains, [*at, "text_sha256"], "n", total, "left")
    return out.select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | (F.col("top.row_id") == F.col("row_id"))).alias("kept"),
        "text_sha256",
    )


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, as ``extendible_dedup`` says.

    Of rows that tie on id and normalised text one stays (which, only matters if other columns differ). Column names of
    ``docs`` may be any.
    """
    cols = docs.columns
    sha, own_id, own_sha, n, kept = common.fresh(cols, "sha", "own_id", "own_sha", "n_rows", "is_kept")
    found = extendible_dedup(docs, id_col, text_col, **how)
    found = found.groupBy(F.col("doc_id").alias(own_id), F.col("text_sha256").alias(own_sha)).agg(F.count(F.lit(1)).alias(n), F.max("kept").alias(kept))
    # by a sort at every size: what is dropped grows with the documents
    found = common.staged(found.where(F.expr(f"{n} > 1 or not {kept}")), "dedup-dropped").hint("merge")
    hashed = docs.withColumn(sha, F.sha2(common.lower_ascii(F.col(text_col)), 256))
    out = hashed.join(found, hashed[id_col].eqNullSafe(found[own_id]) & (hashed[sha] == found[own_sha]), "left")
    once = out.where(F.col(n).isNull()).select(*(hashed[c] for c in cols))
    again = out.where((F.col(n) > 1) & F.col(kept)).dropDuplicates([own_id, own_sha]).select(*(hashed[c] for c in cols))
    return once.unionByName(again)
