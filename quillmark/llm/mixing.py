"""Time-varying curriculum mixing. DataFrame functions only.

Each source has a weight schedule, piecewise linear over the training time 0..1. Its integral, scaled to the source's token
target, is the cumulative demand; a copy of a document is put where that demand reaches the copy's place in its source's
stream. Documents are range-sorted by that position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import common

#: By rank of the source, in turn: weight, and the schedule's knots (time, relative weight).
WEIGHTS = (5, 2, 1)
SCHEDULES = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 0.75), (0.5, 1.5), (1.0, 0.75)),
    ((0.0, 0.25), (1.0, 1.75)),
)


def segments(knots) -> list[tuple[float, float, float, float, float]]:
    """(t0, length, w0, slope, integral before t0) of each piece, normalised so that the whole integral is 1."""
    if len(knots) < 2 or any(b[0] <= a[0] for a, b in zip(knots, knots[1:])) or any(w < 0 for _, w in knots):
        raise ValueError("a schedule needs two knots or more at rising times, with weights of 0 or more")
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
    out, before = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        out.append((t0, t1 - t0, w0 / area, (w1 - w0) / (t1 - t0) / area, before))
        before += (t1 - t0) * (w0 + w1) / 2 / area
    return out


def invert(demand: Column, knots) -> Column:
    """The time at which the normalised cumulative weight reaches ``demand`` (0..1)."""
    col = None
    for t0, length, w0, slope, before in reversed(segments(knots)):
        rest = F.greatest(demand - F.lit(before), F.lit(0.0))
        if slope == 0:
            step = rest / F.lit(w0) if w0 else F.lit(0.0)
        else:
            # the root of slope/2 x**2 + w0 x = rest, written so that it stays exact for small slopes
            root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * rest, F.lit(0.0)))
            step = F.when(rest == 0, F.lit(0.0)).otherwise(2 * rest / (F.lit(w0) + root))
        here = F.lit(t0) + F.least(step, F.lit(length))
        col = here if col is None else F.when(demand >= F.lit(before + length * (w0 + slope * length / 2)), col).otherwise(here)
    return col


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.0, most: float = 3.0) -> DataFrame:
    """source, source_size, rank, weight, target: one row per source (a table of sources, not of documents).

    Weights go round by rank of the source's name (null last). ``share`` times all tokens is dealt out by weight; a target
    stops at ``most`` times its source's size and the excess goes to the others by weight until none is above.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    rank = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.array([F.lit(float(w)) for w in weights])[(F.col("rank") % len(weights)).cast("int")]
    per = per.withColumn("rank", rank).withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    # water level: sources fill in the order of cap / weight; those before a source are full when it is reached
    order = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    whole = W.partitionBy(F.lit(1))
    per = per.withColumn("total", F.sum("source_size").over(whole) * F.lit(float(share)))
    per = per.withColumn("level", F.greatest((F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after), F.lit(0.0)))
    # the first source that its level does not fill sets the level of all that follow
    per = per.withColumn("final", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(whole))
    return per.select("source", "source_size", "rank", "weight", F.least("cap", F.coalesce(F.col("final"), F.lit(float("inf"))) * F.col("weight")).alias("target"))


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns of a row (maps by their entries)."""
    return F.xxhash64(*(F.to_json(F.struct(f"`{f.name}`")) if "map" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema.fields))


def position_of(middle: Column, schedules) -> Column:
    """When a source's demand reaches the share ``middle`` of its target, by the schedule of the source's rank."""
    position = invert(middle, schedules[-1])
    for k, knots in enumerate(schedules[:-1]):
        position = F.when(F.col("rank") % len(schedules) == k, invert(middle, knots)).otherwise(position)
    return position


def middle_of(copy: Column, words: Column) -> Column:
    return (copy * F.col("source_size") + F.col("before") + words / 2) / F.col("target")


def plan(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, share=1.0, most=3.0, buckets=1024, **_) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, rank, tie, before (tokens of its source ahead of it).

    The order within a source is a hash of the id, then of all columns (``tie``), so reruns agree and only equal rows tie; its prefix sums are made in two levels, over
    ``buckets`` hash ranges and then within each, so no task holds a source.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), common.word_count(F.col(text_col)).alias("size"), F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("mix"))).alias("mix_order"), row_hash(docs).alias("tie"))
    rows = rows.withColumn("bucket", F.floor(F.conv(F.substring("mix_order", 1, 6), 16, 10).cast("long") * buckets / (1 << 24)).cast("int"))
    rows = common.staged(rows, "mix-sizes")
    targets = source_targets(rows, weights, share, most)
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    base = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), base.alias("base"))
    inner = W.partitionBy("source", "bucket").orderBy("mix_order", "doc_id", "tie").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    rows = rows.join(sums, F.expr("source <=> s and bucket = b")).withColumn("before", F.col("base") + F.col("inside"))
    t = targets.select(F.col("source").alias("s2"), "source_size", "rank", "target")
    return rows.join(t, F.expr("source <=> s2")).select("doc_id", "source", "size", "source_size", "rank", "target", "before", "tie")


def _taken(copy: Column) -> Column:
    """Words that copy number ``copy`` of a document gives: the stream of the source is read round and round up to its target."""
    left = F.round("target").cast("long") - copy * F.col("source_size") - F.col("before")
    return F.greatest(F.least(left, F.col("size")), F.lit(0))


def copies(planned: DataFrame, schedules=SCHEDULES, most: float = 3.0) -> DataFrame:
    """One row per copy taken: as ``planned`` with copy, words and position (0..1)."""
    rows = planned.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(int(most + 0.999999) - 1)))).withColumn("words", _taken(F.col("copy"))).where("words > 0")
    return rows.withColumn("position", position_of(middle_of(F.col("copy"), F.col("words")), schedules))


def mix(docs: DataFrame, **how) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, positions (of its copies, in training order).

    ``taken`` is the sum of the words of the copies that have a position: the demand of the source's weight schedule is
    integrated, and inverted where the stream of the source reaches the middle of each copy. Rows are range-sorted by their
    first position; those that aren't taken come first.

    Null or empty text has size 0 and is never taken; null is a source of its own, ranked last; repeated rows count each by
    themselves; texts are read whole, however long; extra columns are ignored, whatever their names; an empty table gives no
    rows. The last copy of a source is cut where the target is reached, so a source's taken words are its target rounded to a
    whole number.
    """
    schedules, most = how.get("schedules", SCHEDULES), how.get("most", 3.0)
    numbers = F.array(*(F.lit(k) for k in range(int(most + 0.999999))))
    placed = F.transform(numbers, lambda k: F.struct(_taken(k).alias("words"), position_of(middle_of(k, _taken(k)), schedules).alias("position")))
    rows = plan(docs, **how).withColumn("copies", F.filter(placed, lambda c: c["words"] > 0))
    rows = rows.select("doc_id", "size", "source_size", "target", F.aggregate("copies", F.lit(0).cast("long"), lambda n, c: n + c["words"]).alias("taken"), F.col("copies.position").alias("positions"))
    first = F.get("positions", F.lit(0))
    return rows.repartitionByRange(first, F.col("doc_id")).sortWithinPartitions(first, "doc_id")


def mixed_documents(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", **how) -> DataFrame:
    """The rows of ``docs`` once per copy taken, in training order, with their own columns.

    A copy that is cut holds the text up to the end of its last taken word. Order is by range: part files are in order. Rows
    that are equal in all columns are taken as often as each; column names of ``docs`` may be any.
    """
    cols = docs.columns
    planned = copies(plan(docs, id_col, text_col, source_col, **how), how.get("schedules", SCHEDULES), how.get("most", 3.0))
    tie, own_id, own_tie, n, position, copy, words, size = names = common.fresh(cols, "row_tie", "own_id", "own_tie", "n_rows", "position", "copy", "words", "size")
    picks = common.staged(planned.select(F.col("doc_id").alias(own_id), F.col("tie").alias(own_tie), *(F.col(k).alias(v) for k, v in zip(("position", "copy", "words", "size"), names[4:], strict=True))), "mix-copies")
    rows = docs.withColumn(tie, row_hash(docs))
    # equal rows are one row here, which has the copies of all
    repeated = rows.groupBy(F.col(f"`{id_col}`").alias(own_id), F.col(tie).alias(own_tie)).agg(F.count(F.lit(1)).alias(n))
    repeated = common.staged(repeated.where(F.col(n) > 1).drop(n), "mix-repeated")
    same = lambda a, b: a[id_col].eqNullSafe(b[own_id]) & (a[tie] == b[own_tie])
    single = rows.join(repeated, same(rows, repeated), "left_anti")
    if not repeated.isEmpty():
        single = single.unionByName(rows.join(repeated, same(rows, repeated), "left_semi").dropDuplicates([id_col, tie]))
    out = single.join(picks, same(single, picks))
    head = F.array_join(F.slice(F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(r"[\x20\x09-\x0D]*" + common.WORD), F.lit(0)), F.lit(1), F.col(words).cast("int")), "")
    out = out.withColumn(text_col, F.when(F.col(words) < F.col(size), head).otherwise(F.col(f"`{text_col}`")))
    return out.repartitionByRange(F.col(position), F.col(own_id)).sortWithinPartitions(position, own_id, copy).select(*(f"`{c}`" for c in cols))
