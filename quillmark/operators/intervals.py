"""Joins of time spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _bins(start: Column, end: Column, width: float) -> Column:
    first = F.floor(start / width)
    return F.sequence(first, F.greatest(F.floor(end / width), first))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], span: tuple[str, str], other: tuple[str, str], width: float) -> DataFrame:
    """Rows of both tables with equal ``keys`` whose spans have a time in common (``overlap`` seconds, more than 0).

    Spans are dealt to bins of ``width`` seconds and meet within keys and bin, so a long recording is many groups; a pair that has
    several bins in common comes from the first of them. Width should be near the longer spans' length. Null times meet nothing.
    Columns but the keys must differ in name.
    """
    (a, b), (c, d) = span, other
    left = left.where((F.col(a) <= F.col(b))).withColumn("bin", F.explode(_bins(F.col(a), F.col(b), width)))
    right = right.where((F.col(c) <= F.col(d))).withColumn("bin", F.explode(_bins(F.col(c), F.col(d), width)))
    both = left.join(right, [*keys, "bin"]).where(F.col("bin") == F.greatest(F.floor(F.col(a) / width), F.floor(F.col(c) / width)))
    return both.withColumn("overlap", F.least(b, d) - F.greatest(a, c)).where("overlap > 0").drop("bin")
