"""Text-normalisation, joins and staging helpers of the operators."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..shared import new_path, remove, shared_dir, staged
from ..ship import ship

__all__ = ["HOT", "LOWER", "UPPER", "WARM", "WORD", "fresh", "join_hot", "local_path", "lower_ascii", "new_path", "remove", "shared_dir", "ship", "staged", "table", "word_count"]

#: Rows of a table that are broadcast as its hot ones, at most; rows that make a key hot, at least.
HOT, WARM = 1 << 14, 1000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each made longer until no column has it (Spark doesn't tell upper case from lower)."""
    used, out = {c.lower() for c in taken}, []
    for n in names:
        while n.lower() in used:
            n += "_"
        used.add(n.lower())
        out.append(n)
    return out


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` (unique in ``keys``), whose ``weight`` says how many rows of ``left`` a key has.

    Keys of more than ``total`` / HOT rows are under HOT in number, as weights add up to ``total`` at most: those are broadcast
    (where they have WARM rows or more), and no task gets all rows of one. The others meet by a sort, at any size. ``left`` is
    read twice if there are such keys.
    """
    least = max(total // HOT, WARM)
    heavy, light = right.where(F.col(weight) > least), right.where(F.col(weight) <= least).hint("merge")
    if heavy.isEmpty():
        return left.join(light, keys, how)
    heavy = F.broadcast(heavy)
    return left.join(heavy, keys).unionByName(left.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys, how))


def local_path(uri: str) -> str:
    """The POSIX path of a file: URI; the flat-file format is memory-mapped and needs a mounted folder."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"memory-mapped files need a mounted shared folder, not {uri}")
    return os.path.abspath(uri)


def lower_ascii(c: Column | str) -> Column:
    """A-Z lower-cased and nothing else; null counts as empty."""
    return F.translate(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), UPPER, LOWER)


def word_count(c: Column | str) -> Column:
    return F.regexp_count(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), F.lit(WORD)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
