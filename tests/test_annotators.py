"""Rates and replies of a whole job, with tasks that run twice, fail and are lost."""

import os
import random
import time
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.functions import edit
from quillmark.operators import annotate as A
from quillmark.plans import repair as R


def starts(path):
    """(time, text) of each call, as tasks wrote them."""
    return sorted((float(x.split(" ", 1)[0]), x.split(" ", 1)[1]) for name in os.listdir(path) for x in open(f"{path}/{name}").read().splitlines())


def client(path):
    """Writes down each call; one text of three fails at first."""

    def call(text):
        with open(f"{path}/{os.getpid()}", "a") as f:
            f.write(f"{time.time()} {text}\n")
        if text.endswith("0") and sum(t == text for _, t in starts(path)) == 1:
            raise OSError("busy")
        return text.upper()

    return call


def most_in_a_minute(times, minute):
    minute *= 0.9  # what a task may lose between its slot and its call
    return max(sum(t <= x < t + minute for x in times) for t in times)


def test_rate_and_payment_of_a_job(spark, tmp_path):
    """Two runs of the same job at once, as speculative tasks are: one pays, and no minute has more calls than allowed."""
    (tmp_path / "calls").mkdir()
    rate, minute = 10, 1.0
    backend = A.Remote(client(str(tmp_path / "calls")), back_off=0.01, calls_per_minute=rate, partitions=4, folder=str(tmp_path / "job"), minute=minute)
    texts = spark.createDataFrame([(f"text {k}",) for k in range(30)], "t string")
    with ThreadPoolExecutor(2) as pool:
        first, second = pool.map(lambda _: {r.t: r.annotation for r in backend.run(texts, "t").collect()}, range(2))
    assert first == second == {f"text {k}": f"TEXT {k}" for k in range(30)}
    calls = starts(str(tmp_path / "calls"))
    assert sorted(t for _, t in calls) == sorted([f"text {k}" for k in range(30)] + [f"text {k}" for k in (0, 10, 20)])
    assert most_in_a_minute([x for x, _ in calls], minute) <= rate
    again = backend.run(texts, "t").collect()
    assert len(again) == 30 and len(starts(str(tmp_path / "calls"))) == len(calls)


def test_slots_are_apart(tmp_path):
    ledgers = [A.Ledger(str(tmp_path), 10, minute=0.5) for _ in range(6)]
    for x in ledgers:
        x.start = ledgers[0].start
    times = []

    def take(x):
        for _ in range(8):
            x.wait()
            times.append(time.time())

    with ThreadPoolExecutor(6) as pool:
        list(pool.map(take, ledgers))
    assert len(times) == 48 and most_in_a_minute(times, 0.5) <= 10


def test_lost_tasks_claims_are_given_up(tmp_path):
    def lost(_):
        raise KeyboardInterrupt

    ledger = A.Ledger(str(tmp_path), None, patience=0.3)
    with pytest.raises(KeyboardInterrupt):
        ledger.reply("x", lost)
    began = time.time()
    assert ledger.reply("x", str.upper) == "X" and time.time() - began >= 0.2
    assert ledger.reply("x", lost) == "X"
    with pytest.raises(ValueError, match="mounted"):
        A.Ledger("hdfs://x/y", 1.0)


def plain_shared(tail, head, nominal):
    """Every number of words of the head against every end of the tail, by the full table."""

    def score(a, b):
        row = [-j for j in range(len(b) + 1)]
        for x in a:
            last, row = row, [row[0] - 1]
            for j, y in enumerate(b, 1):
                row.append(max(last[j - 1] + (1 if x == y else -1), last[j] - 1, row[j - 1] - 1))
        return row[-1]

    found = []
    for n in range(len(head) + 1):
        best = max(score(tail[k:], head[:n]) for k in range(len(tail) + 1))
        if best > 0:
            found.append((best - (n - nominal if n > nominal else (nominal - n) / 2), -abs(n - nominal), n))
    return max(found)[2] if found else 0


def test_shared_words_against_the_full_table():
    rng = random.Random(9)
    tails, heads = [], []
    for k in range(150):
        letters = rng.choice([2, 5, 30])
        common = [rng.randrange(letters) for _ in range(rng.randrange(9))]
        spoil = lambda w: [x if rng.random() > 0.15 else 99 for x in w if rng.random() > 0.1]
        tails.append(np.array([rng.randrange(letters) for _ in range(rng.randrange(6))] + spoil(common), np.int64))
        heads.append(np.array(spoil(common) + [rng.randrange(letters) for _ in range(rng.randrange(6))], np.int64))
    got = edit.shared_words(tails, heads, 5)
    assert got.tolist() == [plain_shared(t.tolist(), h.tolist(), 5) for t, h in zip(tails, heads, strict=True)]
    assert edit.shared_words([], [], 5).tolist() == [] and (got > 0).sum() > 50


def test_changed_overlaps_come_once(spark):
    """An annotator that leaves out and changes words of the overlap: every sentence is there once."""
    texts = [(1, " ".join(f"w{k}" for k in range(100))), (2, "short text"), (3, ""), (4, None), (5, " ".join(f"w{k}" for k in range(31)))]
    d = spark.createDataFrame(texts, "k int, t string")
    odd = lambda c: F.regexp_replace(F.regexp_replace(c, r"\bw(\d)7\b ?", ""), r"^w(\d+) ", "W$1 ")
    got = {r.k: r.repaired for r in R.repair(d, "k", "t", A.LocalRules(odd), size=30, overlap=8, dedup_overlap=True).collect()}
    assert got[1].lower().split() == [f"w{k}" for k in range(100) if not (k > 9 and k % 10 == 7)]
    assert got[2] == "short text" and got[3] == got[4] == "" and got[5].lower().split() == [f"w{k}" for k in range(31) if k not in (17, 27)]
