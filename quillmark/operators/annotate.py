"""Annotators: steps that a hosted model would do, each distinct text once, with a local rule-based default."""

from __future__ import annotations

import hashlib
import math
import os
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..shared import new_path
from ..ship import ship


class LocalRules:
    """A column expression per text; nothing leaves the cluster."""

    name = "local"

    def __init__(self, rule: Callable[[Column], Column]):
        self.rule = rule

    def run(self, texts: DataFrame, text: str) -> DataFrame:
        return texts.withColumn("annotation", self.rule(F.col(text)))


class Precomputed:
    """Results from a table of (text, annotation)."""

    name = "precomputed"

    def __init__(self, results: DataFrame):
        self.results = results

    def run(self, texts: DataFrame, text: str) -> DataFrame:
        return texts.join(self.results.select(F.col("text").alias(text), "annotation").dropDuplicates([text]), text, "left")


def in_time(call: Callable[[str], str], x: str, timeout: float | None) -> str:
    """The call's result; TimeoutError if it takes longer (its thread is left behind)."""
    if timeout is None:
        return call(x)
    out: list = []

    def run() -> None:
        try:
            out.append((True, call(x)))
        except Exception as e:  # handed to the caller's thread
            out.append((False, e))

    t = threading.Thread(target=run, daemon=True)
    t.start()
    t.join(timeout)
    if not out:
        raise TimeoutError(f"no reply in {timeout} s")
    if not out[0][0]:
        raise out[0][1]
    return out[0][1]


class Ledger:
    """Call slots and replies of one job in a folder that all its tasks see, so that retried and speculative tasks keep the job's rate
    and don't ask again.

    A slot is a time at which one call may begin; a task has it if it made the slot's file first. Slots that nobody took in time are
    lost, and a task that comes ``late`` to its slot takes another: any ``minute`` (seconds) has ``calls_per_minute`` calls at most, if the
    machines' clocks agree. A text is asked by the task that made its claim; others wait for the reply's file and ask themselves only after
    ``patience`` seconds, when that task must have been lost. Without ``calls_per_minute`` there are no slots.
    """

    def __init__(self, folder: str, calls_per_minute: float | None, patience: float = 120.0, minute: float = 60.0):
        path = folder.removeprefix("file://").removeprefix("file:")
        if "://" in path:
            raise ValueError(f"a job-wide rate needs a mounted shared folder, not {folder}")
        self.top, self.patience, self.start, self.last = unquote(path), patience, time.time(), -1
        self.late = min(0.25, minute / 2 / calls_per_minute) if calls_per_minute else 0.0
        self.gap = (minute + self.late) / calls_per_minute if calls_per_minute else 0.0

    def _made(self, path: str, content: bytes = b"") -> bool:
        """Did this task make the file? Its content is there as soon as its name is."""
        os.makedirs(os.path.dirname(path), exist_ok=True)
        own = f"{path}.{uuid.uuid4().hex}"
        with open(own, "wb") as f:
            f.write(content)
        try:
            os.link(own, path)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(own)

    def wait(self) -> None:
        """Until a slot of this task's own."""
        while self.gap:
            k = max(self.last + 1, math.ceil((time.time() - self.start) / self.gap))
            while not self._made(f"{self.top}/slots/{k // 1000}/{k}"):
                k += 1
            self.last = k
            time.sleep(max(0.0, self.start + k * self.gap - time.time()))
            if time.time() - self.start - k * self.gap <= self.late:
                return

    def reply(self, text: str, ask: Callable[[str], str]) -> str:
        """The reply to a text, asked for once in the whole job."""
        key = hashlib.sha256(text.encode()).hexdigest()
        base, turn = f"{self.top}/replies/{key[:3]}/{key}", 0
        while True:
            if os.path.exists(base):
                with open(base, "rb") as f:
                    return f.read().decode()
            claim = f"{base}.claim{turn}"
            if self._made(claim):
                got = ask(text)
                self._made(base, got.encode())
                return got
            try:
                if time.time() - os.path.getmtime(claim) > self.patience:
                    turn += 1  # whoever had it is lost
                    continue
            except FileNotFoundError:
                pass
            time.sleep(0.05)


class Remote:
    """A user's function of one text, called in Arrow batches: ``tries`` of ``timeout`` seconds with back-off after exceptions, ''
    when they are used up.

    ``calls_per_minute`` is for the whole job, tries and tasks that run again included; replies are kept in ``folder`` (by default a
    new one in the shared folder), so a text is paid once. See ``Ledger``.
    """

    name = "remote"

    def __init__(self, call: Callable[[str], str], tries: int = 3, back_off: float = 1.0, calls_per_minute: float | None = None, partitions: int = 1, timeout: float | None = 30.0, folder: str | None = None, minute: float = 60.0):
        self.call, self.tries, self.back_off, self.partitions, self.timeout = call, tries, back_off, partitions, timeout
        self.calls_per_minute, self.folder, self.minute = calls_per_minute, folder, minute

    def ledger(self, spark: SparkSession) -> Ledger:
        # a lost task's claim is given up when its tries, its waits for slots included, must be over
        waits = self.minute * self.partitions / self.calls_per_minute if self.calls_per_minute else 0.0
        patience = self.tries * ((self.timeout or 600.0) + waits) + self.back_off * 2**self.tries + 60.0
        return Ledger(self.folder or new_path(spark, "calls"), self.calls_per_minute, patience, self.minute)

    def run(self, texts: DataFrame, text: str) -> DataFrame:
        call, tries, back_off, timeout, ledger = self.call, self.tries, self.back_off, self.timeout, self.ledger(texts.sparkSession)
        ship(texts.sparkSession)

        def one(x: str) -> str:
            for k in range(tries):
                ledger.wait()
                try:
                    got = in_time(call, x, timeout)
                    if got:
                        return got
                except Exception:  # whatever a user's client raises counts as a failed try
                    if k + 1 < tries:
                        time.sleep(back_off * 2**k)
            return ""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield f.assign(annotation=[ledger.reply(x, one) for x in f[text]])

        return texts.repartition(self.partitions).mapInPandas(run, T.StructType([*texts.schema.fields, T.StructField("annotation", T.StringType())]))


def annotate(df: DataFrame, text: str, backend, out: str = "annotation") -> DataFrame:
    """``df`` with the backend's result for its text and the backend's name; a null text has a null result."""
    if isinstance(backend, LocalRules):  # an expression needs no join
        return df.withColumn(out, backend.rule(F.col(text))).withColumn("backend", F.lit(backend.name))
    found = backend.run(df.select(text).where(F.col(text).isNotNull()).distinct(), text)
    # hashes are the join's key, so that no text is sorted; texts themselves decide
    found = found.select(F.xxhash64(text).alias("annotated_key"), F.col(text).alias("annotated_text"), F.col("annotation").alias(out))
    same = (F.xxhash64(df[text]) == found["annotated_key"]) & (df[text] == found["annotated_text"])
    return df.join(found, same, "left").drop("annotated_key", "annotated_text").withColumn("backend", F.lit(backend.name))
