"""Lexical retrieval packing.

Documents become token ids once. A shard is a run of documents in the order of their rarest terms, so that lexical
neighbours meet and any hot term is cut into many shards; each shard has a BM25 inverted index over its documents. A seed
document asks the index for its best unused neighbours, which fill the window greedily; the one that doesn't fit is cut, and
what is left of it is the next seed. Corpus statistics (document frequencies, mean length) are counted over all documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import caches, common, tokens

WINDOW = 4096
#: Tokens of a shard, about; BM25's constants.
SHARD_TOKENS, K1, B = 1 << 20, 1.2, 0.75
#: Shards that a task packs one after the other.
TASK_SHARDS = 4
#: Documents that are counted at once (their number times the vocabulary stays under 2**32); a term of more than one in COMMON
#: documents has a row of a table; neighbours that are put in order at once.
BATCH, COMMON, FIRST = 2048, 16, 64

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, id_col="doc_id", text_col="text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, ids) of the documents, ids as little-endian bytes, and (term, df) of each task: one pass over the texts.

    Term -1 counts a task's documents, -2 their tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.Encoder.of(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        df, docs, total = np.zeros(max(enc.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1), np.int64), 0, 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                part = b.column(0).slice(at, BATCH)
                ids = [x + end for x in enc.encode([t or "" for t in b.column(1).slice(at, BATCH).to_pylist()])]
                n = np.array([len(x) // enc.dtype.itemsize for x in ids], np.int64)
                found = np.repeat(np.arange(len(n), dtype=np.uint32) * np.uint32(len(df)), n) + np.frombuffer(b"".join(ids), enc.dtype)
                df += np.bincount(runs(found)[0] % np.uint32(len(df)), minlength=len(df))
                docs, total = docs + len(n), total + int(n.sum())
                zero = np.zeros(len(n), np.int64)
                yield pa.RecordBatch.from_pydict({"doc_id": part, "n": n, "ids": pa.array(ids, pa.binary()), "term": zero, "df": zero, "kind": zero})
                at += BATCH
        if docs:
            at = np.flatnonzero(df)
            term, count = np.concatenate((at, [-1, -2])), np.concatenate((df[at], [docs, total]))
            none = pa.nulls(len(term), pa.int64())
            yield pa.RecordBatch.from_pydict({"doc_id": none, "n": none, "ids": pa.nulls(len(term), pa.binary()), "term": term, "df": count, "kind": np.ones(len(term), np.int64)})
        caches.give_back()  # before the next task's texts come

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    path, spark = common.new_path(docs.sparkSession, "pack-ids"), docs.sparkSession
    rows.mapInArrow(run, "doc_id long, n long, ids binary, term long, df long, kind long").write.partitionBy("kind").parquet(path)
    both = spark.read.schema("doc_id long, n long, ids binary, term long, df long, kind long").parquet(path)
    return both.where("kind = 0").select("doc_id", "n", "ids"), both.where("kind = 1").select("term", "df")


def frequencies(counts: DataFrame, vocabulary: int) -> tuple[np.ndarray, int, int]:
    """Document frequency of each id of the vocabulary, documents, tokens."""
    found = counts.groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # the vocabulary's size at most
    known = dict(zip(found.column("term").to_pylist(), found.column("df").to_pylist(), strict=True))
    n, total = known.pop(-1, 0), known.pop(-2, 0)
    df = np.zeros(vocabulary, np.int64)
    df[list(known.keys())] = list(known.values())
    return df, n, total


def idf(df: np.ndarray, n: int) -> np.ndarray:
    return np.log(1 + (n - df + 0.5) / (df + 0.5)).astype(np.float32)


def routed(rows: DataFrame, dtype: np.dtype, weight: np.ndarray) -> DataFrame:
    """With route: a document's rarest term over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            route = []
            for ids in b.column(2):
                x = np.frombuffer(ids.as_py(), dtype)
                route.append(int(x[np.argmax(weight[x])]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(route, pa.int64())], names=["doc_id", "n", "ids", "route"])

    return rows.select("doc_id", "n", "ids").mapInArrow(run, "doc_id long, n long, ids binary, route long")


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each occurs."""
    x = np.sort(x)
    first = np.ones(len(x), bool)
    first[1:] = x[1:] != x[:-1]
    at = np.flatnonzero(first)
    return x[at], np.diff(np.append(at, len(x)))


class Index:
    """BM25 inverted index of a shard, used documents weigh nothing. Postings by term; a common term's are a row over all documents."""

    def __init__(self, docs: list[np.ndarray], weight: np.ndarray, mean: float):
        size = np.array([len(d) for d in docs], np.int64)
        key, tf = runs(np.repeat(np.arange(len(docs), dtype=np.uint64) * np.uint64(len(weight)), size) + np.concatenate(docs))
        doc, term = np.divmod(key.astype(np.int64), len(weight))
        cut = np.searchsorted(doc, np.arange(len(docs) + 1))
        impact = weight[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / max(mean, 1.0)))
        held = np.bincount(term, minlength=len(weight))
        row_of = np.full(len(weight), -1)
        often = np.flatnonzero(held * COMMON > len(docs))
        row_of[often] = np.arange(len(often))
        at = row_of[term]
        self.rows = np.zeros((len(often), len(docs)), np.float32)
        self.rows[at[at >= 0], doc[at >= 0]] = impact[at >= 0]
        rare = np.flatnonzero(at < 0)
        rare = rare[np.argsort(term[rare], kind="stable")]
        self.doc, self.impact = doc[rare], impact[rare].astype(np.float32)
        self.first = np.searchsorted(term[rare], np.arange(len(weight) + 1))
        self.often, self.rare = ([x[a:z][m[a:z]] for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)] for x, m in ((at, at >= 0), (term, at < 0)))
        self.unused = np.ones(len(docs), bool)

    def neighbours(self, d: int) -> Iterator[int]:
        """Unused documents that share a term with document ``d``, the best first; equal ones by their order."""
        score = self.rows[self.often[d]].sum(0)
        first = self.first[self.rare[d]]
        held = self.first[self.rare[d] + 1] - first
        at = np.repeat(first - np.cumsum(held) + held, held) + np.arange(held.sum())
        if len(at):
            score = score + np.bincount(self.doc[at], self.impact[at], minlength=len(score))
        found = np.flatnonzero(self.unused & (score > 0))
        value = -score[found]
        if len(found) > 2 * FIRST:  # mostly the first few fill the window
            near = value <= np.partition(value, FIRST)[FIRST]
            yield from found[near][np.argsort(value[near], kind="stable")].tolist()
            found, value = found[~near], value[~near]
        yield from found[np.argsort(value, kind="stable")].tolist()


def pack(docs: list[np.ndarray], weight: np.ndarray, mean: float, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; every sequence but the last is full."""
    index, out = Index(docs, weight, mean), []
    sequence = offset = 0
    todo = iter(np.argsort([-len(d) for d in docs], kind="stable").tolist())

    def put(d: int) -> bool:
        """Put a document to its end; did it cross a window's end?"""
        nonlocal sequence, offset
        index.unused[d] = False
        start, crossed = 0, False
        while start < len(docs[d]):
            n = min(len(docs[d]) - start, window - offset)
            out.append((d, start, n, sequence, offset))
            start, offset = start + n, offset + n
            if offset == window:
                sequence, offset, crossed = sequence + 1, 0, True
        return crossed

    seed = None
    while True:
        if seed is None:
            seed = next((d for d in todo if index.unused[d]), None)
            if seed is None:
                return out
            put(seed)
            if not offset:  # it ended with its window
                seed = None
                continue
        last, seed = seed, None
        for d in index.neighbours(last):
            if put(d):
                seed = d if offset else None
                break


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, id_col="doc_id", text_col="text", window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null or empty text is its end id alone; null ids stay null; texts are read whole, however long; repeated rows and ids are
    packed each; extra columns are ignored, whatever their names; an empty table gives no rows. Equal scores rank by order of
    id. Each shard leaves at most one sequence that isn't full: a task goes through its documents in order and starts a new shard
    after about ``shard_tokens``, however many documents share a route.
    """
    enc = tokens.Encoder.of(tokenizer)
    dtype, vocabulary = enc.dtype, max(enc.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
    spark = docs.sparkSession
    common.ship(spark)
    rows, counts = tokenized(docs, tokenizer, end_id, id_col, text_col)
    df, n, total = frequencies(counts, vocabulary)
    if not n:
        return spark.createDataFrame([], SCHEMA)
    weight, mean = idf(df, n), total / n
    tasks = max(1, -(-total // (TASK_SHARDS * shard_tokens)))
    # ranges of (route, size, id) hold about the same number of documents, also of one route
    order = ("route", "n", "doc_id")
    placed = routed(rows, dtype, weight).repartitionByRange(tasks, *order).sortWithinPartitions(*order, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        caches.claim("packing", lambda: None)  # the encoder's words are not needed any more
        base, ids, raw, held = TaskContext.get().partitionId() << 32, [], [], 0

        def packed() -> pa.RecordBatch:
            nonlocal base, held
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, raw[i]))
            texts = [np.frombuffer(raw[i], dtype) for i in order]
            pieces = pack(texts, weight, mean, window)
            d = [p[0] for p in pieces]
            crc = [zlib.crc32(texts[p[0]][p[1] : p[1] + p[2]].astype("<u4").tobytes()) for p in pieces]
            out = pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([ids[order[x]] for x in d], pa.int64()),
                    "start": pa.array([p[1] for p in pieces], pa.int64()),
                    "length": pa.array([p[2] for p in pieces], pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                    "doc_tokens": pa.array([len(texts[x]) for x in d], pa.int64()),
                    "sequence_id": pa.array([base + p[3] for p in pieces], pa.int64()),
                    "offset": pa.array([p[4] for p in pieces], pa.int64()),
                }
            )
            base += 1 + max(p[3] for p in pieces)
            ids.clear()
            raw.clear()
            held = 0
            return out

        for b in batches:
            for d, n_ids, x in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                ids.append(d)
                raw.append(x)
                held += n_ids
                if held >= shard_tokens:
                    yield packed()
        if ids:
            yield packed()

    return placed.select("doc_id", "n", "ids").mapInArrow(run, SCHEMA)
