"""Pair metrics over word arrays and texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numbers import numbers
from .text import ratio


def length_penalty(n_ref: Column, n_hyp: Column) -> Column:
    return F.when(n_ref > 0, F.greatest(F.lit(0.0), 1 - F.abs(n_hyp.cast("double") / n_ref - 1))).otherwise(F.lit(0.0))


def length_ratio(n_ref: Column, n_hyp: Column) -> Column:
    return n_hyp.cast("double") / F.greatest(n_ref, F.lit(1))


def token_overlap(ref: Column, hyp: Column) -> Column:
    return F.size(F.array_intersect(ref, hyp)).cast("double") / F.greatest(F.size(F.array_distinct(ref)), F.size(F.array_distinct(hyp)), F.lit(1))


def jaccard(ref: Column, hyp: Column) -> Column:
    """Of distinct words, as they are written."""
    return F.size(F.array_intersect(ref, hyp)).cast("double") / F.greatest(F.size(F.array_union(ref, hyp)), F.lit(1))


def jaccard_folded(ref: Column, hyp: Column) -> Column:
    """Of distinct lower-cased words; 0 if either side is empty."""
    low = lambda c: F.transform(c, F.lower)
    return F.when((F.size(ref) > 0) & (F.size(hyp) > 0), jaccard(low(ref), low(hyp))).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two number arrays; 0 if either is all zeros."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return ratio(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def judged_number(reply: Column) -> Column:
    """The first number of a judge's reply, clipped to 0..1 (a sign in front of it doesn't count); null without one."""
    found = F.regexp_extract(reply, r"([0-9]*\.?[0-9]+)", 1).try_cast("double")
    return F.when(found.isNotNull(), F.least(F.greatest(found, F.lit(0.0)), F.lit(1.0)))


def similarity(ref: Column, hyp: Column, judged: Column | None = None, encoded: Column | None = None) -> Column:
    """The first backend that has a value: a judge's number clipped to 0..1, an encoder's cosine floored at 0, Jaccard."""
    # greatest and least pass over nulls, and a missing number is no 0
    found = [F.when(judged.isNotNull(), F.least(F.greatest(judged, F.lit(0.0)), F.lit(1.0)))] if judged is not None else []
    found += [F.when(encoded.isNotNull(), F.greatest(encoded, F.lit(0.0)))] if encoded is not None else []
    return F.coalesce(*found, jaccard_folded(ref, hyp))


def number_recall(ref: Column, hyp: Column) -> Column:
    """Recall of the reference's distinct numbers, from two arrays; 1 without any."""
    r = F.array_distinct(ref)
    return F.when(F.size(r) > 0, F.size(F.array_intersect(r, hyp)).cast("double") / F.size(r)).otherwise(F.lit(1.0))


def number_accuracy(ref_text: str, hyp_text: str) -> Column:
    """Recall of numbers between two text columns, by their names."""
    return number_recall(numbers(ref_text), numbers(hyp_text))


def grade(rate: Column) -> Column:
    """Error rate to a grade of 5 to 1; unknown is 3."""
    return F.when(rate.isNull(), 3).when(rate < 0.1, 5).when(rate < 0.2, 4).when(rate < 0.3, 3).when(rate < 0.5, 2).otherwise(1)


def heuristic_quality(wer_r: Column, mer_r: Column, wil_r: Column, length_p: Column) -> Column:
    return wer_r * 0.4 + mer_r * 0.3 + wil_r * 0.2 + length_p * 0.1


#: Weights of the reward's parts: fixed values.
WEIGHTS = {"wer": 0.15, "entity": 0.40, "repetition": 0.10, "semantic": 0.15, "speaker": 0.10, "number": 0.10}


def reward_parts(wer: Column, entity: Column, repetition: Column, semantic: Column, speaker: Column, number: Column) -> dict[str, Column]:
    return {
        "wer": F.greatest(F.lit(0.0), 1 - wer) * WEIGHTS["wer"],
        "entity": entity * WEIGHTS["entity"],
        "repetition": F.greatest(F.lit(0.0), 1 - repetition / 5) * WEIGHTS["repetition"],
        "semantic": semantic * WEIGHTS["semantic"],
        "speaker": speaker * WEIGHTS["speaker"],
        "number": number * WEIGHTS["number"],
    }


def reward_score(parts: dict[str, Column]) -> Column:
    total = F.lit(0.0)
    for c in parts.values():
        total = total + c
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def bucket(score: Column) -> Column:
    return F.when(score >= 0.8, "excellent").when(score >= 0.6, "good").when(score >= 0.4, "fair").otherwise("poor")


def confidence_stats(values: Column) -> dict[str, Column]:
    """Mean, least, most, population deviation and the shares under 0.5 and over 0.8; nothing given counts as one 0.8."""
    v = F.when(F.size(F.coalesce(values, F.array().cast("array<double>"))) > 0, values).otherwise(F.array(F.lit(0.8)))
    n = F.size(v).cast("double")
    total = lambda f: F.aggregate(v, F.lit(0.0), lambda s, x: s + f(x))
    mean = total(lambda x: x) / n
    # the mean is bound once: inside the inner lambda it would be made again for each value
    spread = F.transform(F.array(mean), lambda m: F.sqrt(F.aggregate(F.transform(v, lambda x: (x - m) * (x - m)), F.lit(0.0), lambda s, x: s + x) / n))[0]
    return {
        "mean_confidence": mean, "min_confidence": F.array_min(v), "max_confidence": F.array_max(v), "std_confidence": spread,
        "low_confidence_ratio": total(lambda x: (x < 0.5).cast("double")) / n, "high_confidence_ratio": total(lambda x: (x > 0.8).cast("double")) / n,
    }
