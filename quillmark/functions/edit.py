"""Word edit distance and alignment: Arrow functions over two columns of word arrays, of any length and vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..ship import ship


def _pairs(ref: pa.Array, hyp: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The word arrays of each row as numbers, equal where words are; null is empty."""
    words = pa.concat_arrays([x.flatten().cast(pa.large_string()) for x in (ref, hyp)])
    codes = words.dictionary_encode().indices.to_numpy()
    ends = [np.cumsum(x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist() for x in (ref, hyp)]
    at, to = 0, ends[0][-1] if ends[0] else 0
    for a, b in zip(*ends, strict=True):
        b += ends[0][-1]
        yield codes[at:a], codes[to:b]
        at, to = a, b


def levenshtein(ref: list, hyp: list) -> int:
    """Distance of two sequences: the columns of the table as bits of whole numbers, a few operations per word of ``hyp``."""
    start, n, m = 0, len(ref), len(hyp)
    while start < n and start < m and ref[start] == hyp[start]:
        start += 1
    while n > start and m > start and ref[n - 1] == hyp[m - 1]:
        n, m = n - 1, m - 1
    if n == start or m == start:
        return max(n, m) - start
    at: dict = {}
    for i in range(start, n):
        at[ref[i]] = at.get(ref[i], 0) | 1 << (i - start)
    distance = n - start
    whole, last = (1 << distance) - 1, 1 << (distance - 1)
    up, down = whole, 0  # cells that are one more, one less than the cell above
    for w in hyp[start:m]:
        same = at.get(w, 0)
        across = (((same & up) + up) ^ up) | same
        more = down | whole & ~(across | up)
        less = up & across
        distance += bool(more & last) - bool(less & last)
        more = more << 1 | 1
        same |= down
        up = (less << 1 | ~(same | more)) & whole
        down = more & same & whole
    return distance


#: Cells of a step that are worked out together, and edits beyond which distances alone are had by bits of whole numbers.
CELLS, MANY = 1 << 14, 96


def _least(a: np.ndarray, b: np.ndarray) -> int:
    """A bound of the distance from below: words of the longer side that the other can't pair off."""
    (x, n), (y, m) = (np.unique(c, return_counts=True) for c in (a, b))
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return max(len(a), len(b)) - int(np.minimum(n[i], m[j]).sum())


def _banded(pairs: list[tuple[np.ndarray, np.ndarray]], most: int) -> tuple[np.ndarray, np.ndarray]:
    """(distances, hits) of pairs in order of falling length, exact where a distance is ``most`` or less.

    An alignment of so few edits stays on ``most`` + 1 diagonals. The table's cells on them are worked out row by row for all pairs
    at once: time is length times edits. Cost and hits are one number, as a hit takes 1 off and an edit costs more than all hits;
    cells are less by their diagonal's insertions, so that insertions are a running minimum.
    """
    n, m = (np.array([len(x[side]) for x in pairs]) for side in (0, 1))
    rows, wide, big = int(n[0]), most + 1, int(np.minimum(n, m).max()) + 1
    far = (int((n + m).max()) + wide + 2) * big
    kind = np.int32 if far + 2 * wide * big < 1 << 31 else np.int64
    first = -((most - (m - n)) // 2)  # each pair's lowest diagonal
    words, others = np.full((rows, len(pairs)), -2, np.int32), np.full((len(pairs), rows + wide), -1, np.int32)
    for p, (a, b) in enumerate(pairs):
        words[: len(a), p] = a
        own = b[: rows + wide + first[p]]
        others[p, -first[p] : len(own) - first[p]] = own
    cells = np.full((len(pairs), wide + 1), far, kind)
    cells[:, :wide][first[:, None] + np.arange(wide) >= 0] = 0
    step, down = np.empty((len(pairs), wide), kind), np.empty((len(pairs), wide), kind)
    out, live = np.zeros(len(pairs), np.int64), np.searchsorted(-n, -np.arange(rows + 2), side="right")
    for i in range(rows):
        k = live[i + 1]  # pairs that have this row
        best, over, row = step[:k], down[:k], cells[:k]
        np.multiply(others[:k, i : i + wide] == words[i, :k, None], kind(-1 - big), out=best)
        best += kind(big)
        best += row[:, :wide]
        np.add(row[:, 1:], kind(2 * big), out=over)
        np.minimum(best, over, out=best)
        np.minimum.accumulate(best, axis=1, out=row[:, :wide])
        for p in range(live[i + 2], k):
            out[p] = int(cells[p, m[p] - n[p] - first[p]]) + int(m[p] - n[p]) * big
    distance = -(-out // big)
    return distance, distance * big - out


def solve(pairs: Iterator[tuple[np.ndarray, np.ndarray]], hits: bool = True) -> list[tuple[int, int]]:
    """(distance, hits) of each pair: the most equal words among alignments of least cost. Without ``hits`` these may be 0.

    Words that both sides begin or end with are hits. A band of as many edits as words can't be paired off comes first, and one of
    twice as many where that was too narrow.
    """
    out: list[tuple[int, int]] = []
    todo = []
    for a, b in pairs:
        k = min(len(a), len(b))
        lead = np.flatnonzero(a[:k] != b[:k])
        start = int(lead[0]) if len(lead) else k
        a, b, k = a[start:], b[start:], k - start
        tail = np.flatnonzero(a[len(a) - k :][::-1] != b[len(b) - k :][::-1])
        end = int(tail[0]) if len(tail) else k
        a, b = a[: len(a) - end], b[: len(b) - end]
        out.append((max(len(a), len(b)), start + end))
        if len(a) and len(b):
            todo.append((max(_least(a, b), abs(len(a) - len(b))), len(out) - 1, a, b))
    if not hits:
        for most, x, a, b in todo:
            if most > MANY:
                out[x] = levenshtein(a.tolist(), b.tolist()), 0
        todo = [t for t in todo if t[0] <= MANY]
    while todo:
        todo.sort(key=lambda t: (t[0].bit_length(), len(t[2])), reverse=True)
        size = todo[0][0].bit_length()
        most = max(t[0] for t in todo if t[0].bit_length() == size)
        now = [t for t in todo[: max(CELLS // (most + 1), 1)] if t[0].bit_length() == size]
        todo = todo[len(now) :]
        for (least, x, a, b), distance, found in zip(now, *(c.tolist() for c in _banded([t[2:] for t in now], most)), strict=True):
            if distance <= most:
                out[x] = distance, out[x][1] + found
            else:
                todo.append((min(max(2 * most, 16), max(len(a), len(b))), x, a, b))
    return out


def _distances(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    return pa.array([d for d, _ in solve(_pairs(ref, hyp), hits=False)], pa.int64())


def _alignments(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    both = solve(_pairs(ref, hyp))
    return pa.StructArray.from_arrays([pa.array([d for d, _ in both], pa.int64()), pa.array([h for _, h in both], pa.int64())], ["distance", "hits"])


def _shipped() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship(spark)


def word_distance(ref: Column, hyp: Column) -> Column:
    """Word Levenshtein distance of two word arrays; null counts as empty."""
    _shipped()
    return F.arrow_udf(_distances, "long")(ref, hyp)


def alignment(ref: Column, hyp: Column) -> Column:
    """struct<distance, hits> of two word arrays: the most equal words among alignments of least cost."""
    _shipped()
    return F.arrow_udf(_alignments, "struct<distance:long,hits:long>")(ref, hyp)


def error_rate(distance: Column, n_ref: Column, n_hyp: Column) -> Column:
    """Distance over reference words; an empty reference gives 0 for an empty hypothesis, else 1."""
    return F.when(n_ref > 0, distance.cast("double") / n_ref).otherwise(F.when(n_hyp > 0, F.lit(1.0)).otherwise(F.lit(0.0)))


def align(ref, hyp) -> tuple[int, int]:
    """(distance, hits) of two sequences of words."""
    ids: dict = {}
    a, b = (np.array([ids.setdefault(w, len(ids)) for w in x], np.int32) for x in (ref, hyp))
    return solve([(a, b)])[0]


def aligned(df: DataFrame, ref: str = "ref_words", hyp: str = "hyp_words") -> DataFrame:
    """With distance and hits of each row's word arrays (null as empty)."""
    both = df.withColumn("distance", alignment(F.col(ref), F.col(hyp)))
    return both.withColumns({"distance": F.col("distance.distance"), "hits": F.col("distance.hits")})


def match_error_rate(distance: Column, hits: Column) -> Column:
    return F.when(distance + hits > 0, distance.cast("double") / (distance + hits)).otherwise(F.lit(0.0))


def information_lost(hits: Column, n_ref: Column, n_hyp: Column) -> Column:
    lost = 1 - (hits.cast("double") / n_ref) * (hits.cast("double") / n_hyp)
    return F.when((n_ref > 0) & (n_hyp > 0), lost).otherwise(F.when((n_ref == 0) & (n_hyp == 0), F.lit(0.0)).otherwise(F.lit(1.0)))


def reward(rate: Column) -> Column:
    """1 less the rate, at least 0; a rate that couldn't be had gives 0."""
    return F.coalesce(F.greatest(F.lit(0.0), 1 - rate), F.lit(0.0))


def shared_words(tails: list[np.ndarray], heads: list[np.ndarray], nominal: int) -> np.ndarray:
    """How many words of each head repeat the end of its tail, if words may have been changed, left out or put in on either side.

    A head's first words are aligned with the tail's last ones (a hit counts 1, an edit -1; the tail's own first words are free). Of
    all numbers of words the best counts, less 1 for each word over ``nominal`` and a half for each word under it; of equal ones the
    nearest to that, then the larger. There is no overlap where edits are as many as hits. All pairs go through the table together, row by row.
    """
    wide, rows = max((len(h) for h in heads), default=0), max((len(t) for t in tails), default=0)
    a, b = np.full((rows, len(tails)), -2, np.int64), np.full((len(heads), wide), -1, np.int64)
    for k, (t, h) in enumerate(zip(tails, heads, strict=True)):
        if len(t):
            a[rows - len(t) :, k] = t
        b[k, : len(h)] = h
    places = np.arange(wide + 1)
    # padding above a tail matches nothing, and its rows are free as those of its own first words
    best = np.tile(-places, (len(tails), 1))
    for i in range(rows):
        step = best - 1
        step[:, 1:] = np.maximum(step[:, 1:], best[:, :-1] + np.where(b == a[i, :, None], 1, -1))
        step[:, 0] = 0
        best = np.maximum.accumulate(step + places, axis=1) - places
    far = np.abs(places - nominal)
    halves = np.where(places > nominal, 2, 1) * far
    value = (2 * best - halves) * (4 * (wide + nominal) + 4) - 2 * far + (places > nominal)
    value[(best <= 0) | (places > np.array([len(h) for h in heads])[:, None])] = np.iinfo(np.int64).min
    return np.where((value > np.iinfo(np.int64).min).any(1), value.argmax(1), 0)


def overlap_words(tail: Column, head: Column, nominal: int) -> Column:
    """``shared_words`` of two columns of word arrays; null counts as empty."""
    _shipped()

    def run(tails: pa.Array, heads: pa.Array) -> pa.Array:
        pairs = list(_pairs(tails, heads))
        return pa.array(shared_words([t for t, _ in pairs], [h for _, h in pairs], nominal), pa.int64())

    return F.arrow_udf(run, "long")(tail, head)
