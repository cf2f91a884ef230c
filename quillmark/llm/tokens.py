"""Token ids of public tokenizers and the flat binary format: unsigned integers, 64-bit document offsets.

A part of a table is three flat files: ``.ids`` (little-endian unsigned 16- or 32-bit ids, by the vocabulary's size),
``.off`` (64-bit offsets of its documents in the whole table's id stream, one more than documents) and ``.doc`` (64-bit
document ids, beside ``.null``: a byte per document, 1 where the id is null). Partition bases are prefix sums over the parts' counts. Readers map the files into memory.
"""

from __future__ import annotations

import json
import os
import re
import sys
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import caches, common

#: White space by Unicode's property, which the tokenizers' patterns mean by \\s.
_WS = "\t-\r \x85\xa0  -     　"
#: What a byte-level pattern never joins: a run with the one blank before it; white space up to the last before a run.
_BYTE_LEVEL = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]")
_WORDS = re.compile(f"[^{_WS}]+")

#: Distinct words, pieces of words and other segments kept by a worker, of so many characters; more are encoded each time they come.
CACHE_WORDS, CACHE_PIECES, CACHE_SEGMENTS, CACHE_CHARS = 1_000_000, 340_000, 100_000, 40
#: Characters of texts that are worked on at once.
CHUNK = 8 << 20
#: Bytes of text that one part holds, about, where the session's number of partitions would give more.
PART_BYTES = 256 << 20
#: Texts of these characters alone are cut by the tokenizers' own patterns, written out for them: ASCII and Latin letters.
_LATIN = "ß-öø-ÿ"
_RARE = re.compile("[^\x00-\x7fÀ-ÖØ-öø-ÿ]")
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_LATIN_BYTE_LEVEL = re.compile(rf"{_CONTRACTIONS}| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9À-ÖØ-öø-ÿ]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
#: Where a blank may not start a word's segment, for byte-level patterns; what str.split takes for white space and they don't.
_ODD_BLANK = re.compile(r"[ \t-\r] (?:[ \t-\r]|\Z)")
_ODD_SPLIT = re.compile("[\x1c-\x1f]")
_LATIN_WORDS = re.compile(rf"{_CONTRACTIONS}|[a-z{_LATIN}]+|[0-9]|[^ \t-\ra-z0-9{_LATIN}]+")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers write for each byte: itself where it can be seen, else the next one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (b for b in range(256) if b not in seen)
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_LETTER = _byte_letters()
_MARKS = frozenset(".,;:!?")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Cache(dict):
    """Ids by text, made when they are first asked for."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, s: str) -> bytes:
        ids = self.make(s)
        if len(self) < self.most and len(s) <= CACHE_CHARS:
            self[s] = ids
        return ids


class Encoder:
    """Exact ids of a tokenizer file, encoding each distinct segment once.

    Byte-level and word-level patterns never cross the cuts made here, so the ids of a text are those of its segments. Texts of
    common characters are cut at blanks; each new word is cut by the pattern itself, and the library's merges are applied to
    each new piece.
    Special tokens' strings in a text are ordinary text. A tokenizer of another kind is applied to whole texts.
    """

    _of: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.segments = self._cuts(spec)
        self.byte_level = self.segments == _BYTE_LEVEL.findall
        self.code = {2: "H", 4: "I"}[self.dtype.itemsize]
        self.cache: dict[str, bytes] = {}
        self.pieces = _Cache(self._piece_ids, CACHE_PIECES)
        # words whose ids are known, those ids one after the other, and where a word's begin (a byte-level word is kept without the
        # blank before it): no Python object is made for a word that is known
        self.words, self.word_ids, self.word_at = pa.array([], pa.large_string()), np.zeros(0, self.dtype), np.zeros(1, np.int64)

    @classmethod
    def of(cls, path: str) -> "Encoder":
        caches.claim("tokens", cls._of.clear)
        if path not in cls._of:
            cls._of.clear()
            cls._of[path] = cls(path)
        return cls._of[path]

    @staticmethod
    def _cuts(spec: dict) -> Callable[[str], list[str]] | None:
        before, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and norm is None:
            return _BYTE_LEVEL.findall
        steps = before.get("pretokenizers") or []
        norms = [n["type"] for n in (norm or {}).get("normalizers", [])]
        if steps and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and r"\s" in steps[0]["pattern"].get("Regex", "") and set(norms) <= {"NFC", "Replace", "Lowercase"}:
            return _WORDS.findall
        return None

    def _ids(self, parts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        if array(self.code).itemsize == self.dtype.itemsize and sys.byteorder == "little":
            return [array(self.code, e.ids).tobytes() for e in found]
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def _piece_ids(self, p: str) -> bytes:
        """Ids of a piece that the pattern has cut already: the library's merges on its bytes' letters."""
        letters = p.replace(" ", _LETTER[32]) if p.isascii() and p.isprintable() else "".join([_LETTER[b] for b in p.encode()])
        ids = [t.id for t in self.tokenizer.model.tokenize(letters)]
        return array(self.code, ids).tobytes() if sys.byteorder == "little" else np.array(ids, self.dtype).tobytes()

    def _word_ids(self, w: str) -> bytes:
        """Ids of a word (a byte-level one has a blank before it): letters are one piece, a mark at their end is one more."""
        lead = " " if self.byte_level else ""
        if not self.byte_level:
            w = w.lower()
        if w.isalpha():
            return self.pieces[lead + w]
        if w[-1:] in _MARKS and w[:-1].isalpha():
            return self.pieces[lead + w[:-1]] + self.pieces[w[-1]]
        return self._cut_ids(lead + w)

    def _cut_ids(self, s: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, (_LATIN_BYTE_LEVEL if self.byte_level else _LATIN_WORDS).findall(s)))

    def _common_ids(self, texts: list[str]) -> list[bytes]:
        """Ids of texts of common characters: each distinct word is looked up once, its ids are copied to all its places."""
        whole = pa.array(texts, pa.large_string())
        cut = pc.split_pattern(whole, " ") if self.byte_level else pc.ascii_split_whitespace(whole)
        words = cut.flatten().dictionary_encode()
        code, at, distinct = words.indices.to_numpy(), cut.offsets.to_numpy(), words.dictionary
        place = pc.index_in(distinct, value_set=self.words).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(place < 0)
        missing = distinct.take(pa.array(new))
        ids = [self._word_ids(w) for w in missing.to_pylist()]
        fresh = np.frombuffer(b"".join(ids), self.dtype) if any(ids) else np.zeros(0, self.dtype)
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize)
        known = np.concatenate((self.word_ids, fresh))
        edge = np.concatenate((self.word_at, self.word_at[-1] + ends))
        place[new] = len(self.words) + np.arange(len(new))
        first, size = edge[place], edge[place + 1] - edge[place]
        keep = min(len(new), CACHE_WORDS - len(self.words))
        if keep > 0:
            self.words = pa.concat_arrays([self.words, missing.slice(0, keep)])
            self.word_at = edge[: len(self.words) + 1].copy()
            self.word_ids = known[: self.word_at[-1]].copy()
        held = size[code]
        if self.byte_level:  # the first word of a text has no blank before it
            held[at[:-1]] = 0
        upto = np.zeros(len(held) + 1, np.int64)
        np.cumsum(held, out=upto[1:])
        source = np.repeat(first[code] - upto[:-1], held)
        source += np.arange(len(source))
        raw, bounds = known[source].tobytes(), (upto[at] * self.dtype.itemsize).tolist()
        found = [raw[a:z] for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
        return [self._cut_ids(t.split(" ", 1)[0]) + x for t, x in zip(texts, found, strict=True)] if self.byte_level else found

    def _keep(self, new: dict[str, bytes]) -> None:
        room = CACHE_SEGMENTS - len(self.cache)
        for s, b in new.items():
            if room <= 0:
                return
            if len(s) <= CACHE_CHARS:
                self.cache[s] = b
                room -= 1

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes of ``dtype``."""
        if self.segments is None:
            return self._ids(texts)
        out, rare, common, size = [b""] * len(texts), {}, [], 0

        def flush() -> None:
            nonlocal size
            for k, x in zip(common, self._common_ids([texts[k] for k in common]), strict=True):
                out[k] = x
            known = self._known(list(set().union(*rare.values())), self._ids)
            for k, parts in rare.items():
                out[k] = b"".join(map(known.__getitem__, parts))
            common.clear()
            rare.clear()
            size = 0

        odd = _ODD_BLANK if self.byte_level else _ODD_SPLIT
        for k, t in enumerate(texts):
            if _RARE.search(t):
                rare[k] = self.segments(t)
            elif odd.search(t):
                out[k] = self._cut_ids(t if self.byte_level else t.lower())
            else:
                common.append(k)
            size += len(t)
            if size > CHUNK:
                flush()
        flush()
        return out

    def _known(self, parts: list[str], encode) -> dict[str, bytes]:
        found = dict(zip(parts, map(self.cache.get, parts)))
        missing = [p for p, ids in found.items() if ids is None]
        if missing:
            new = dict(zip(missing, encode(missing), strict=True))
            self._keep(new)
            found.update(new)
        return found


def crc_u32(ids: bytes, dtype: np.dtype) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.frombuffer(ids, dtype).astype("<u4").tobytes())


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> list[dict]:
    """Write ``docs`` in ascending order of id below ``path`` (a folder that executors and driver share); the parts, in order.

    Null text is an empty document (its end id alone); rows without an id come first; repeated ids keep a row each, ordered by
    a hash of the text; texts are read whole, however long; extra columns are ignored, whatever their names; an empty table
    gives no parts. A part has about ``PART_BYTES`` of text at most. A part's files appear by one rename each, so a task that is
    run again replaces them with the same bytes.
    """
    spark = docs.sparkSession
    common.ship(spark)
    folder = common.local_path(path)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES), 1)
    # ranges are sampled from ids and hashes: no text goes to the driver
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc = Encoder.of(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        os.makedirs(folder, exist_ok=True)
        name, tries = f"{folder}/part-{part:06d}", uuid.uuid4().hex
        counts, ids, none = [], [], []
        with open(f"{name}.ids.{tries}", "wb") as f:
            for b in batches:
                texts, at = b.column(1), 0
                while at < len(texts):
                    for x in enc.encode(texts.slice(at, 2048).to_pylist()):
                        f.write(x)
                        f.write(end)
                        counts.append(len(x) // enc.dtype.itemsize + 1)
                    at += 2048
                ids.append(b.column(0).fill_null(0).to_numpy())
                none.append(b.column(0).is_null().to_numpy(zero_copy_only=False))
        if not counts:
            os.remove(f"{name}.ids.{tries}")
            return
        np.array(counts, "<i8").tofile(f"{name}.n.{tries}")
        np.concatenate(ids).astype("<i8").tofile(f"{name}.doc.{tries}")
        np.concatenate(none).astype("u1").tofile(f"{name}.null.{tries}")
        for kind in ("ids", "n", "doc", "null"):
            os.replace(f"{name}.{kind}.{tries}", f"{name}.{kind}")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "docs": pa.array([len(counts)], pa.int64()), "tokens": pa.array([sum(counts)], pa.int64()), "width": pa.array([enc.dtype.itemsize], pa.int64())})

    made = sorted((r.asDict() for r in rows.mapInArrow(write, "part long, docs long, tokens long, width long").collect()), key=lambda r: r["part"])
    base = 0  # prefix sums over the parts, of which there are as many as tasks
    for r in made:
        r["base"], base = base, base + r["tokens"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                name, tries = f"{folder}/part-{part:06d}", uuid.uuid4().hex
                counts = np.fromfile(f"{name}.n", "<i8")
                np.concatenate(([at], at + np.cumsum(counts))).astype("<i8").tofile(f"{name}.off.{tries}")
                os.replace(f"{name}.off.{tries}", f"{name}.off")
            yield pa.RecordBatch.from_pydict({"part": b.column(0)})

    if made:
        parts = spark.createDataFrame([(r["part"], r["base"]) for r in made], "part long, base long")
        parts.repartition(min(len(made), n)).mapInArrow(place, "part long").collect()
    return made


def read_tokens(spark: SparkSession, path: str, made: list[dict]) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32."""
    common.ship(spark)
    folder = common.local_path(path)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not made:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, base, width in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                name, dtype = f"{folder}/part-{part:06d}", np.dtype(f"<u{width}")
                off = np.memmap(f"{name}.off", "<i8", "r")
                ids = np.memmap(f"{name}.ids", dtype, "r")
                docs, none = np.fromfile(f"{name}.doc", "<i8"), np.fromfile(f"{name}.null", "u1")
                local = np.asarray(off) - base
                crc = [zlib.crc32(ids[a:z].astype("<u4").tobytes()) for a, z in zip(local[:-1].tolist(), local[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(docs, mask=none == 1),
                        "start": pa.array(np.asarray(off[:-1])),
                        "n_tokens": pa.array(np.diff(local)),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    }
                )

    parts = spark.createDataFrame([(r["part"], r["base"], r["width"]) for r in made], "part long, base long, width long")
    return parts.repartition(len(made)).mapInArrow(read, schema)
