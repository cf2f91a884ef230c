"""Language-model scores by a subword lattice.

A word's lattice has an edge for every piece of an existing vocabulary that fits; the pieces' scores weight all segmentations,
and the forward recursion in log space sums them to the word's marginal probability. A piece's weight is a mixture of the
vocabulary's own score (by its rank) and of expected counts over the word types of the training documents, which start from
those scores. One more edge spans a whole word: its weight is the word's own discounted count, and the discounted mass weights the subword paths.

Weights are per class of training documents (their language, where the table has it). A document's class is never looked at
when it is scored: its probability is the classes' mixture, each the product of its tokens' marginals.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common, words

_WORD = re.compile(common.WORD)
_LOWER = str.maketrans(common.UPPER, common.LOWER)
LN10 = float(np.log(10))

#: Taken off every counted word; share of that mass for the class's own lattice (the rest is for words of all classes);
#: classes (the rarer ones are one class); re-estimation rounds.
DISCOUNT, OWN, MAX_CLASSES, ROUNDS = 0.6, 0.8, 6, 2
#: Share of a piece's weight that stays the vocabulary's own score.
GIVEN = 0.25
#: Bound of a piece's code points (none: the longest piece is the vocabulary's); words of a numpy batch; documents' bytes of a scoring block, about.
MAX_PIECE, BATCH, BLOCK_BYTES = sys.maxsize, 4096, 24 << 20


def split(raw: bytes) -> list[bytes]:
    """Words of UTF-8 bytes: both methods know ASCII alone, so A-Z are lower-cased and ASCII white space splits."""
    return raw.lower().split()


def tokens_of(text: str | None) -> list[str]:
    return [w.decode() for w in split((text or "").encode())]


class Vocabulary:
    """Pieces of a sentencepiece model, told apart as first in a word and later in it, with bytes for all else."""

    _of: dict[str, "Vocabulary"] = {}

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces: dict[tuple[bool, str], float] = {}
        for i in range(sp.get_piece_size()):
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i):
                continue
            p, rank = sp.id_to_piece(i), -sp.get_score(i)
            first = p.startswith("▁")
            body = p[1:] if first else p
            if body and "▁" not in body and len(body) <= MAX_PIECE and body == body.translate(_LOWER) and not _WORD.sub("", body):
                pieces[first, body] = 1.0 / (rank + 20.0)
                if first:  # any piece may go on inside a word
                    pieces.setdefault((False, body), 0.2 / (rank + 20.0))
                else:
                    pieces.setdefault((True, body), 0.2 / (rank + 20.0))
        self.hash = {}
        keys = sorted(pieces)
        self.longest = max((len(k[1]) for k in keys), default=0)
        weight = np.array([pieces[k] for k in keys])
        # 256 bytes more for each place: they spell what no piece covers
        low = weight.min(initial=1e-5) / 50
        self.first = np.array([k[0] for k in keys] + [True] * 256 + [False] * 256)
        self.start = np.concatenate((weight, np.full(512, low)))
        codes = np.array([piece_hash(k[1], k[0]) for k in keys], np.uint64)
        order = np.argsort(codes)
        self.codes, self.index = codes[order], order.astype(np.int64)
        self.n = len(keys)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[_short(self.codes)] = True

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``h``, piece) of the hashes that are pieces'; most others fail at the first look."""
        at = np.flatnonzero(self.maybe[_short(h)])
        k = np.searchsorted(self.codes, h[at])
        k[k == self.n] = 0
        hit = self.codes[k] == h[at]
        return at[hit], self.index[k[hit]]

    @classmethod
    def of(cls, path: str) -> "Vocabulary":
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def normalised(self, mass: np.ndarray) -> np.ndarray:
        """Log probabilities: first pieces sum to 1, later pieces and the end of the word to 1 (the end is the last entry)."""
        first, later = mass[:-1] * self.first, mass[:-1] * ~self.first
        with np.errstate(divide="ignore"):
            return np.log(np.append(first / first.sum() + later / (later.sum() + mass[-1]), mass[-1] / (later.sum() + mass[-1])))

    def initial(self) -> np.ndarray:
        return self.normalised(np.append(self.start, self.start[~self.first].sum() * 0.5))


_PIECE_BASE = 0x100000001B3 | 1


def _short(h: np.ndarray) -> np.ndarray:
    return (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)


def piece_hash(body: str, first: bool) -> np.uint64:
    h = 0x9E3779B9 if first else 0x7F4A7C15
    for ch in body:
        h = (h * _PIECE_BASE + ord(ch) + 1) & 0xFFFFFFFFFFFFFFFF
    return np.uint64(h)


def lattice(batch: list[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges of many words at once: word, from, to, piece; and each word's length. A byte edge is as many bytes as its character."""
    size = np.array([len(w) for w in batch], np.int64)
    longest = int(size.max(initial=1))
    raw = np.frombuffer("".join(batch).encode("utf-32-le", "surrogatepass"), "<u4")
    code = np.full((len(batch), longest), 0, np.uint32)
    code[np.arange(longest)[None, :] < size[:, None]] = raw
    word = np.repeat(np.arange(len(batch)), size)
    place = np.arange(len(raw)) - np.repeat(np.cumsum(size) - size, size)
    live = np.arange(len(raw))
    h = np.where(place == 0, np.uint64(0x9E3779B9), np.uint64(0x7F4A7C15))
    out: list[tuple[np.ndarray, ...]] = []
    for n in range(1, min(vocab.longest, longest) + 1):  # pieces of n characters, at all places at once
        fits = place[live] + n <= size[word[live]]
        live, h = live[fits], h[fits]
        h = h * np.uint64(_PIECE_BASE) + raw[live + n - 1].astype(np.uint64) + np.uint64(1)
        hit, piece = vocab.lookup(h)
        at = live[hit]
        out.append((word[at], place[at], place[at] + n, piece))
    if not out:
        out = [tuple(np.zeros(0, np.int64) for _ in range(4))]
    return *(np.concatenate(x) for x in zip(*out, strict=True)), size, code


def sorted_lattice(batch: list[str], vocab: Vocabulary):
    word, a, z, piece, size, code = lattice(batch, vocab)
    order = np.argsort(z.astype(np.uint16) if code.shape[1] < 1 << 16 else z, kind="stable")
    return word[order], a[order], z[order], piece[order], size, code


def byte_scores(code: np.ndarray, size: np.ndarray, logp: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Log weight of spelling each character in bytes (at the start of a word its first byte is a first piece)."""
    goes_on = np.log1p(-np.exp(logp[-1]))
    first, later = logp[vocab.n : vocab.n + 256], logp[vocab.n + 256 : vocab.n + 512]
    chars, back = np.unique(code, return_inverse=True)
    table = np.zeros((2, len(chars)))
    for x, c in enumerate(chars.tolist()):
        b = list(chr(c).encode("utf-8", "surrogatepass"))
        tail = sum(later[y] for y in b[1:])
        table[:, x] = first[b[0]] + tail, later[b[0]] + tail
    back = back.reshape(code.shape)
    out = table[1][back]
    out[:, 0] = table[0][back[:, 0]]
    return out


def forward(batch: list[str], vocab: Vocabulary, logp: np.ndarray, expect: np.ndarray | None = None, weight: np.ndarray | None = None, edges=None) -> np.ndarray:
    """Log marginal probability of each word; adds expected piece counts to ``expect`` (backward recursion) if given."""
    word, a, z, piece, size, code = edges or sorted_lattice(batch, vocab)
    longest, n = code.shape[1], len(batch)
    spell = byte_scores(code, size, logp, vocab)
    cut = np.searchsorted(z, np.arange(1, longest + 2))
    alpha = np.full((n, longest + 1), -np.inf)
    alpha[:, 0] = 0.0
    score = logp[piece]
    for j in range(1, longest + 1):
        e = slice(cut[j - 1], cut[j])
        by_byte = alpha[:, j - 1] + spell[:, j - 1]
        top = by_byte.copy()
        value = alpha[word[e], a[e]] + score[e]
        np.maximum.at(top, word[e], value)
        safe = np.where(np.isfinite(top), top, 0.0)
        total = np.exp(by_byte - safe)
        np.add.at(total, word[e], np.exp(value - safe[word[e]]))
        with np.errstate(divide="ignore"):
            alpha[:, j] = np.where(size >= j, safe + np.log(total), -np.inf)
    rows = np.arange(n)
    out = alpha[rows, size] + logp[-1]
    if expect is not None:
        beta = np.full((n, longest + 1), -np.inf)
        beta[rows, size] = logp[-1]
        by_start = np.argsort(a, kind="stable")
        cut = np.searchsorted(a[by_start], np.arange(longest + 1))
        for i in range(longest - 1, -1, -1):
            e = by_start[cut[i] : cut[i + 1]]
            by_byte = beta[:, i + 1] + spell[:, i]
            value = score[e] + beta[word[e], z[e]]
            top = np.where(np.isfinite(by_byte), by_byte, -1e300)
            np.maximum.at(top, word[e], value)
            total = np.exp(np.minimum(by_byte - top, 0))
            np.add.at(total, word[e], np.exp(value - top[word[e]]))
            with np.errstate(divide="ignore"):
                beta[:, i] = np.where(i < size, top + np.log(total), beta[:, i])
        share = np.exp(alpha[word, a] + score + beta[word, z] - out[word]) * weight[word]
        expect[:-1] += np.bincount(piece, share, minlength=len(expect) - 1)
        expect[-1] += weight.sum()
        for i in range(longest):  # spelt characters count for their bytes, in bulk
            s = np.where(size > i, np.exp(np.minimum(alpha[:, i] + spell[:, i] + beta[:, i + 1] - out, 0)), 0.0) * weight
            if s.max(initial=0) > 1e-6:
                for x in np.flatnonzero(s > 1e-6):
                    b = list(chr(int(code[x, i])).encode("utf-8", "surrogatepass"))
                    for k, y in enumerate(b):
                        expect[vocab.n + y + (0 if i == 0 and k == 0 else 256)] += s[x]
    return out


def word_batches(found: list[str]) -> Iterator[np.ndarray]:
    """Positions of words of about the same length together; very long ones in small batches."""
    order = np.argsort([len(w) for w in found], kind="stable")
    at = 0
    while at < len(order):
        longest = len(found[order[min(at + BATCH, len(order)) - 1]])
        step = max(1, min(BATCH, 400_000 // max(1, longest * 4)))
        yield order[at : at + step]
        at += step


def log_words(found: list[str], vocab: Vocabulary, logps: np.ndarray) -> np.ndarray:
    """Log marginals of words under each line of ``logps``: a column per line."""
    logps = np.atleast_2d(logps)
    out = np.zeros((len(found), len(logps)))
    for part in word_batches(found):
        batch = [found[i] for i in part]
        edges = sorted_lattice(batch, vocab)
        for k, logp in enumerate(logps):
            out[part, k] = forward(batch, vocab, logp, edges=edges)
    return out


def count_words(rows: DataFrame, classes: int) -> DataFrame:
    """word, c0, c1, ...: training counts of every word by class, from (text, train, k); words of other rows only come with 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [Counter() for _ in range(classes)]
        other: set[bytes] = set()

        def flush():
            other.difference_update(*seen)
            found = [w for s in seen for w in s]
            k = [x for x, s in enumerate(seen) for _ in s]
            n = [c for s in seen for c in s.values()]
            b = pa.RecordBatch.from_pydict({"word": pa.array(found + list(other), pa.string()), "k": pa.array(k + [0] * len(other), pa.int64()), "n": pa.array(n + [0] * len(other), pa.int64())})
            for s in (*seen, other):
                s.clear()
            return b

        for b in batches:
            for raw, train, k in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                (seen[k] if train else other).update(split(raw))
                if sum(map(len, seen)) + len(other) > 400_000:
                    yield flush()
        if other or any(seen):
            yield flush()

    found = rows.mapInArrow(run, "word string, k long, n long")
    return found.groupBy("word").agg(*(F.sum(F.when(F.col("k") == x, F.col("n")).otherwise(0)).alias(f"c{x}") for x in range(classes)))


def estimate(types: DataFrame, path: str, classes: int, rounds: int) -> np.ndarray:
    """Log weights of the pieces by class: the vocabulary's, mixed with ``rounds`` of expected counts over the word types of a class."""
    vocab = Vocabulary.of(path)
    logps = np.array([vocab.initial()] * classes)
    size = logps.shape[1]
    seen = types.where(" or ".join(f"c{k} > 0" for k in range(classes)))
    for _ in range(rounds):
        now = logps

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            v = Vocabulary.of(path)
            expect = np.zeros(now.shape)
            for b in batches:
                found = b.column(0).to_pylist()
                counts = np.array([b.column(k + 1).to_numpy() for k in range(classes)])
                for k in range(classes):
                    own = [found[i] for i in np.flatnonzero(counts[k])]
                    for part in word_batches(own):
                        forward([own[i] for i in part], v, now[k], expect[k], np.ones(len(part)))
            at = np.flatnonzero(expect)
            if len(at):
                yield pa.RecordBatch.from_pydict({"piece": at, "mass": expect.ravel()[at]})

        mass = np.array([np.append(vocab.start / vocab.start.sum(), 1.0)] * classes)  # one count in all keeps every piece possible
        for r in seen.mapInArrow(run, "piece long, mass double").groupBy("piece").agg(F.sum("mass").alias("mass")).collect():  # one row per piece and class
            mass[divmod(r.piece, size)] += r.mass
        logps = np.array([vocab.normalised(m) for m in mass])
    if not rounds:
        return logps
    given = vocab.initial()
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(GIVEN) + given, np.log(1 - GIVEN) + logps)


def lm_scores(docs: DataFrame, train, vocabulary: str, id_col="doc_id", text_col="text", class_col: str | None = "lang", rounds: int = ROUNDS, discount: float = DISCOUNT) -> DataFrame:
    """One row per input row: doc_id, train, n_tokens, n_known, train_tokens, base_score, score.

    ``train``: a boolean column expression over ``docs``; ``class_col``: classes of the training rows (None: one class; null
    is a class). Null text counts as empty: its only token is the end. Texts and words are read whole, however long, in time
    linear in them. Repeated rows and ids count and are scored each; classes of equal size rank by name; extra columns are
    ignored, whatever their names; an empty table gives no rows. Without training tokens the words' lattices alone score, each token as
    likely an end as a word.
    """
    common.ship(docs.sparkSession)
    cls = F.coalesce(F.col(class_col).cast("string"), F.lit("")) if class_col and class_col in docs.columns else F.lit("")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), cls.alias("cls"))
    common_classes = rows.where("train").groupBy("cls").count().orderBy(F.desc("count"), "cls").limit(MAX_CLASSES).collect()
    names = [r.cls for r in common_classes]
    index = F.lit(len(names))
    for k, name in enumerate(names):
        index = F.when(F.col("cls") == name, F.lit(k)).otherwise(index)
    n_classes = len(names) + 1  # the last is for all others
    rows = rows.select("doc_id", "train", "text", index.cast("long").alias("k"))
    types = common.staged(count_words(rows.select("text", "train", "k"), n_classes), "lm-types")
    ends = np.zeros(n_classes)
    for r in rows.where("train").groupBy("k").count().collect():
        ends[r.k] = r["count"]
    all_c = "+".join(f"c{k}" for k in range(n_classes))
    got = types.agg(F.expr(f"sum({all_c})"), F.expr(f"count_if({all_c} > 0)"), *(F.sum(f"c{k}") for k in range(n_classes)), *(F.count_if(F.col(f"c{k}") > 0) for k in range(n_classes))).first()
    n_words, v_words = int(got[0] or 0), int(got[1] or 0)
    n_of, v_of = (np.array([float(x or 0) for x in got[a : a + n_classes]]) for a in (2, 2 + n_classes))
    if not ends[-1] and len(names):  # no rarer classes
        n_classes -= 1
        ends, n_of, v_of = ends[:-1], n_of[:-1], v_of[:-1]
    types = types.select("word", *(f"c{k}" for k in range(n_classes)))
    n_ends = int(ends.sum())
    total, distinct = n_words + n_ends, v_words + (n_ends > 0)
    base = 0.1 * (distinct + 1)
    logps = estimate(types, vocabulary, n_classes, rounds)
    share = ends / n_ends if n_ends else np.ones(n_classes) / n_classes
    d, totals = discount, n_of + ends

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary.of(vocabulary)
        with np.errstate(divide="ignore"):
            log_share = np.log(share)
            for b in batches:
                sub = log_words(b.column(0).to_pylist(), vocab, logps)
                c = np.array([b.column(k + 1).to_numpy() for k in range(n_classes)], float).T
                mixed = np.logaddexp.reduce(sub + log_share, axis=1)
                every = np.logaddexp(np.log(np.maximum(c.sum(1) - d, 0.0)), np.log(d * v_words) + mixed) - np.log(n_words) if n_words else mixed
                back = np.logaddexp(np.log(OWN) + sub, (np.log(1 - OWN) + every)[:, None])
                p = np.where(n_of > 0, np.logaddexp(np.log(np.maximum(c - d, 0.0)), np.log(np.maximum(d * v_of, 1e-300)) + back) - np.log(np.maximum(totals, 1.0)), np.log(0.5) + back)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c.sum(1).astype(np.int64)), pa.array(list(p / LN10), pa.list_(pa.float32()))], names=["word", "c", "p"])

    types = common.staged(types.mapInArrow(weigh, "word string, c long, p array<float>"), "lm-words")
    end_p = np.log10(np.where(n_of > 0, np.maximum(ends, 0.5) / np.maximum(totals, 1.0), 0.5))
    with np.errstate(divide="ignore"):
        prior = np.log10(share)
    end_base = float(np.log10((n_ends + 0.1) / (total + base)))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    # a block by hash of id and text: its documents and the words that they ask for meet
    rows = rows.select("doc_id", "train", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"))

    def ask(block: pa.Table) -> pa.Table:
        asked: set[bytes] = set()
        for raw in block.column("text").cast(pa.binary()).to_pylist():
            asked.update(split(raw))
        return pa.table({"block": pa.array(np.full(len(asked), block.column("block")[0].as_py()), pa.int64()), "word": pa.array(list(asked), pa.string())})

    # the same shuffle of documents serves here and below
    wanted = rows.groupBy("block").applyInArrow(ask, "block long, word string")
    answers = wanted.join(types, "word").select("block", "word", "c", "p")

    def total_up(left: pa.Table, right: pa.Table) -> pa.Table:
        at = {w: i for i, w in enumerate(right.column("word").cast(pa.binary()).to_pylist())}
        c = np.append(right.column("c").to_numpy(), 0)
        log_base = np.log10((c + 0.1) / (total + base))
        p = np.zeros((len(c), n_classes))
        if len(at):
            p[:-1] = right.column("p").combine_chunks().flatten().to_numpy().reshape(-1, n_classes)
        out: dict[str, list] = {k: [] for k in ("n_tokens", "n_known", "base_score", "score")}
        for raw in left.column("text").cast(pa.binary()).to_pylist():
            i = np.fromiter(map(at.__getitem__, split(raw)), np.int64)
            out["n_tokens"].append(len(i) + 1)
            out["n_known"].append(int((c[i] > 0).sum()) + (n_ends > 0))
            out["base_score"].append(float(log_base[i].sum()) + end_base)
            out["score"].append(float(np.logaddexp.reduce((prior + end_p + p[i].sum(0)) * LN10) / LN10))
        return pa.table({"doc_id": left.column("doc_id"), "train": left.column("train"), "n_tokens": pa.array(out["n_tokens"], pa.int64()), "n_known": pa.array(out["n_known"], pa.int64()), "base_score": pa.array(out["base_score"], pa.float64()), "score": pa.array(out["score"], pa.float64())})

    scored = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(total_up, "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(total).cast("long"))
