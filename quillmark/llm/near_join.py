"""Set-similarity join of documents by count-vector R-trees.

A document's set of word shingles is hashed into groups; the counts per group are a point. The overlap of two sets is at most
the sum over the groups of the lesser count, so an R-tree over points prunes whole boxes of pairs, and only surviving pairs are
verified on the sets themselves.

The tree is sharded: sets of similarity t or more share one of the first n - ceil(t n) + 1 shingles of each in any order of all
shingles, so a shard holds the points of the documents that have one such shingle. Rarer shingles come first in that order
(by counts over all documents, hashed to a fixed number of counters), which keeps shards small. Equal sets are one point. In
the shard of the first shingle that a pair shares, nothing before it is common: what each set has from there on (its room)
bounds the overlap as well. A shard's pairs are never listed: its documents are first verified against hubs (one document per
shard and round), which merges groups of near copies in work that is linear in them; the trees then only join what is in
different components. In a large shard, documents carry the parities of finer counts too: every parity in which two sets
differ is a shingle that only one of them has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import caches, common, words

#: Counters of shingle frequency, and of a block that is summed at once; groups of a point, and of the folded point that shards carry for sets under LONG shingles.
COUNTERS, BLOCK, GROUPS, FOLDED, LONG = 1 << 20, 1 << 14, 128, 32, 1500
#: Points of a leaf; documents of a shard that one task joins (larger shards are joined by pairs of tiles); hub rounds.
LEAF, TILE, HUB_ROUNDS = 32, 2048, 4
#: Hubs of a large shard in each round after the first; bits of the parities that its documents carry.
HUBS, PARITIES = 8, 1024


def sets_of(texts: pa.Array, n: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(index of the first text, sorted shingle sets) of runs of texts. Fewer words than ``n`` are one shingle; none, an empty set."""
    for at, data, off in words.chunks(texts):
        w = words.Words(data, off)
        h = w.hashes(fold_case=True)
        s = words.shingles(h, n)
        out = []
        for a, z in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
            if z - a >= n:
                out.append(np.unique(s[a : z - n + 1]))
            elif z > a:
                out.append(words.mix(words.shingles(h[a:z], z - a) + np.uint64(z - a)))
            else:
                out.append(np.zeros(0, np.uint64))
        yield at, out


def counter(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(40)).astype(np.int64) % COUNTERS


def frequencies(docs: DataFrame, n: int) -> np.ndarray:
    """Rarity class of each counter (log scale, 0: unseen), from how often its shingles occur in sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for b in batches:
            for _, found in sets_of(b.column(0), n):
                total += np.bincount(counter(np.concatenate(found)), minlength=COUNTERS)
        live = [k for k in range(COUNTERS // BLOCK) if total[k * BLOCK : (k + 1) * BLOCK].any()]
        yield pa.RecordBatch.from_pydict({"k": pa.array(live, pa.int64()), "n": pa.array([total[k * BLOCK : (k + 1) * BLOCK].astype("<u4").tobytes() for k in live], pa.binary())})
        caches.give_back()  # a worker waits with little memory, whatever comes next

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(raw.as_buffer(), "<u4").astype(np.int64)
        yield pa.RecordBatch.from_pydict({"k": pa.array(list(sums), pa.int64()), "n": pa.array([x.astype("<i8").tobytes() for x in sums.values()], pa.binary())})

    out = np.zeros(COUNTERS, np.int64)
    found = docs.select("text").mapInArrow(run, "k long, n binary").repartition("k").mapInArrow(add, "k long, n binary").toArrow()  # COUNTERS numbers
    for k, raw in zip(found.column("k").to_pylist(), found.column("n").to_pylist(), strict=True):
        out[k * BLOCK : (k + 1) * BLOCK] = np.frombuffer(raw, "<i8")
    return (1024 * np.log2(1.0 + out)).astype(np.uint16)


def signed(docs: DataFrame, freq: np.ndarray, n: int, num: int, den: int) -> DataFrame:
    """doc_id, n, h1 and h2 (128 bits of the set), point (counts as unsigned 16-bit integers; the highest: that or more), odd (bits:
    the parities of finer counts), prefix (shingles to shard by)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, found in sets_of(b.column(1), n):
                rows: dict[str, list] = {k: [] for k in ("n", "h1", "h2", "point", "odd", "prefix")}
                for s in found:
                    m = len(s)
                    rows["n"].append(m)
                    rows["h1"].append(int(s.sum(dtype=np.uint64).astype(np.int64)))
                    rows["h2"].append(int(words.mix(s ^ np.uint64(0x51ED270B7A2F39D1)).sum(dtype=np.uint64).astype(np.int64)))
                    odd = np.bincount((s >> np.uint64(20) & np.uint64(PARITIES - 1)).astype(np.int64), minlength=PARITIES) & 1
                    rows["odd"].append(np.packbits(odd.astype(np.uint8)).tobytes())
                    rows["point"].append(np.minimum(np.bincount((s & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS), 65535).astype("<u2").tobytes())
                    keep = m - -(-num * m // den) + 1 if m else 0
                    rows["prefix"].append(s[np.argsort(freq[counter(s)], kind="stable")[:keep]].astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(found)), pa.array(rows["n"], pa.int64()), pa.array(rows["h1"], pa.int64()), pa.array(rows["h2"], pa.int64()), pa.array(rows["point"], pa.binary()), pa.array(rows["odd"], pa.binary()), pa.array(rows["prefix"], pa.list_(pa.int64()))],
                    names=["doc_id", "n", "h1", "h2", "point", "odd", "prefix"],
                )
        caches.give_back()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, h1 long, h2 long, point binary, odd binary, prefix array<long>")


def may_link(n_a, n_b, least_sum, num: int, den: int):
    """Can sets of these sizes, whose overlap is at most ``least_sum``, be as similar as num / den?"""
    return (den * np.minimum(n_a, n_b) >= num * np.maximum(n_a, n_b)) & ((num + den) * least_sum >= num * (n_a + n_b))


def leaves(size: np.ndarray, point: np.ndarray) -> list[np.ndarray]:
    """Bulk-loaded leaves: slices by size, each sliced by its most spread coordinate."""
    order = np.argsort(size, kind="stable")
    out, slab = [], LEAF * max(1, int(np.sqrt(len(order) / LEAF)))
    for a in range(0, len(order), slab):
        part = order[a : a + slab]
        axis = int(np.argmax(point[part].astype(np.float64).var(0)))
        part = part[np.argsort(point[part, axis], kind="stable")]
        out += [part[i : i + LEAF] for i in range(0, len(part), LEAF)]
    return out


def tree_join(size: np.ndarray, point: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) that the bounds leave, over an R-tree of two levels of boxes."""
    own = leaves(size, point)
    high = np.array([point[x].max(0) for x in own])
    lo, hi = np.array([size[x].min() for x in own]), np.array([size[x].max() for x in own])
    for k, a in enumerate(own):
        bound = np.minimum(high[k], high[k:]).sum(1, dtype=np.int64)
        near = (den * hi[k:] >= num * lo[k]) & (den * hi[k] >= num * lo[k:]) & ((num + den) * bound >= num * (lo[k] + lo[k:]))
        for j in np.flatnonzero(near) + k:
            b = own[j]
            overlap = np.minimum(point[a][:, None, :], point[b][None, :, :]).sum(2, dtype=np.int64)
            ok = may_link(size[a][:, None], size[b][None, :], overlap, num, den)
            if j == k:
                ok &= np.arange(len(a))[:, None] < np.arange(len(b))[None, :]
            i, m = np.nonzero(ok)
            if len(i):
                yield a[i], b[m]


def small_pairs(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) inside runs of at most LEAF rows; they are tested where they are made and not kept."""
    left = [np.zeros(0, np.int64)]
    right = [np.zeros(0, np.int64)]
    for gap in range(1, int(count.max(initial=1))):
        m = count > gap
        reps = count[m] - gap
        base = np.repeat(first[m], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        left.append(base)
        right.append(base + gap)
    return np.concatenate(left), np.concatenate(right)


def fold_point(raw: pa.Array, n: pa.Array) -> pa.Array:
    """Points of one byte a group, folded to FOLDED groups for small sets; 255 stands for that count or more."""
    p = np.frombuffer(b"".join(raw.to_pylist()), "<u2").reshape(-1, GROUPS)
    small = np.minimum(p.reshape(-1, GROUPS // FOLDED, FOLDED).sum(1), 255).astype(np.uint8)
    whole = np.minimum(p, 255).astype(np.uint8)
    return pa.array([(w if m >= LONG else s).tobytes() for w, s, m in zip(whole, small, n.to_pylist(), strict=True)], pa.binary())


def _open(p: np.ndarray, size: np.ndarray, top: int = 255) -> np.ndarray:
    """Counts as integers; a count of ``top`` or more bounds nothing but by the set's size (under 2**30: texts have under 2**31 bytes)."""
    p = p.astype(np.int32)
    return np.where(p == top, size.astype(np.int32)[:, None], p)


def opened(raw: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded points of all, whole points of long sets, and each row's place among the latter (-1: none)."""
    is_long = size >= LONG
    at = np.full(len(raw), -1)
    at[is_long] = np.arange(is_long.sum())
    whole = _open(np.frombuffer(b"".join(r for r, m in zip(raw, is_long, strict=True) if m), np.uint8).reshape(-1, GROUPS), size[is_long])
    point = np.zeros((len(raw), FOLDED), np.int32)
    point[~is_long] = _open(np.frombuffer(b"".join(r for r, m in zip(raw, is_long, strict=True) if not m), np.uint8).reshape(-1, FOLDED), size[~is_long])
    point[is_long] = np.minimum(whole.reshape(-1, GROUPS // FOLDED, FOLDED).sum(1, dtype=np.int64), size[is_long][:, None])
    return point, whole, at


def shard_candidates(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a < b) of different components that the trees leave. rows: key, i, j (tiles), side, doc, n, room, comp, point, odd (or null), in order of shard."""

    def joined(t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        new = np.ones(len(t["key"]), bool)
        new[1:] = (np.diff(t["key"]) != 0) | (np.diff(t["i"]) != 0) | (np.diff(t["j"]) != 0)
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(new)))
        point, whole, at_whole = opened(t["point"].tolist(), t["n"])
        has = np.array([x is not None for x in t["odd"]], bool)
        at_odd = np.where(has, np.cumsum(has) - 1, -1)
        odd = np.frombuffer(b"".join(x for x in t["odd"] if x is not None), np.uint64).reshape(-1, PARITIES // 64)
        out: list[np.ndarray] = []

        def keep(i, j):
            fits = (t["comp"][i] != t["comp"][j]) & may_link(t["n"][i], t["n"][j], np.minimum(t["room"][i], t["room"][j]), num, den)
            i, j = i[fits], j[fits]
            both = np.flatnonzero((at_odd[i] >= 0) & (at_odd[j] >= 0))
            for at in range(0, len(both), 50_000):
                k = both[at : at + 50_000]
                apart = np.bitwise_count(odd[at_odd[i[k]]] ^ odd[at_odd[j[k]]]).sum(1, dtype=np.int64)
                total = t["n"][i[k]] + t["n"][j[k]]
                both[at : at + 50_000][may_link(t["n"][i[k]], t["n"][j[k]], (total - apart) // 2, num, den)] = -1
            left = np.ones(len(i), bool)
            left[both[both >= 0]] = False
            i, j = i[left], j[left]
            both = np.flatnonzero((at_whole[i] >= 0) & (at_whole[j] >= 0))
            for at in range(0, len(both), 50_000):  # long sets have a closer bound
                k = both[at : at + 50_000]
                far = ~may_link(t["n"][i[k]], t["n"][j[k]], np.minimum(whole[at_whole[i[k]]], whole[at_whole[j[k]]]).sum(1, dtype=np.int64), num, den)
                both[at : at + 50_000][~far] = -1
            left = np.ones(len(i), bool)
            left[both[both >= 0]] = False
            i, j = i[left], j[left]
            m = (t["i"][i] == t["j"][i]) | (t["side"][i] != t["side"][j])
            if m.any():
                a, b = t["doc"][i[m]], t["doc"][j[m]]
                out.append(np.stack((np.minimum(a, b), np.maximum(a, b))))

        small = count <= LEAF
        i, j = small_pairs(first[small], count[small])
        m = (den * np.minimum(t["n"][i], t["n"][j]) >= num * np.maximum(t["n"][i], t["n"][j])) & (t["comp"][i] != t["comp"][j])
        i, j = i[m], j[m]
        for at in range(0, len(i), 50_000):
            x, y = i[at : at + 50_000], j[at : at + 50_000]
            ok = may_link(t["n"][x], t["n"][y], np.minimum(point[x], point[y]).sum(1, dtype=np.int64), num, den)
            keep(x[ok], y[ok])
        for a, c in zip(first[~small].tolist(), count[~small].tolist(), strict=True):
            for i, j in tree_join(t["n"][a : a + c], point[a : a + c], num, den):
                keep(i + a, j + a)
        pairs = np.unique(np.concatenate(out, 1), axis=1) if out else np.zeros((2, 0), np.int64)
        return pairs[0], pairs[1]

    names = ("key", "i", "j", "side", "doc", "n", "room", "comp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for b in batches:
            t = {k: b.column(x).to_numpy(zero_copy_only=False) for x, k in enumerate(names)}
            for x, k in enumerate(("point", "odd"), len(names)):
                t[k] = np.empty(b.num_rows, object)
                t[k][:] = b.column(x).to_pylist()
            if held is not None:
                t = {k: np.concatenate((held[k], v)) for k, v in t.items()}
            # the last shard may go on in the next batch
            last = (t["key"] == t["key"][-1]) & (t["i"] == t["i"][-1]) & (t["j"] == t["j"][-1])
            held = {k: v[last] for k, v in t.items()}
            if not last.all():
                a, z = joined({k: v[~last] for k, v in t.items()})
                yield pa.RecordBatch.from_pydict({"a": a, "b": z})
        if held is not None:
            a, z = joined(held)
            yield pa.RecordBatch.from_pydict({"a": a, "b": z})
        caches.give_back()

    return rows.select(*names, "point", "odd").mapInArrow(run, "a long, b long")


def same_words(a: str, b: str, n: int, num: int, den: int) -> bool:
    """Are the two texts' shingles, as words, as similar as num / den?"""
    x, y = ({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or {tuple(w)} for w in (t.encode().lower().split() for t in (a, b)))
    both = len(x & y)
    return den * both >= num * (len(x) + len(y) - both)


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, n: int, num: int, den: int, repeats: bool) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are as similar as num / den: by their whole points first, then by hashes of their
    shingles, then by the words of the shingles."""
    p = reps.select("node", "n", "point")
    e = pairs.join(p.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("point").alias("p_a")), "a")
    e = e.join(p.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("point").alias("p_b")), "b").select("a", "b", "n_a", "n_b", "p_a", "p_b")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                c = b.slice(at, 4096)
                size = [c.column(k).to_numpy() for k in (2, 3)]
                p_a, p_b = (_open(np.frombuffer(b"".join(c.column(k).to_pylist()), "<u2").reshape(-1, GROUPS), m, 65535) for k, m in zip((4, 5), size, strict=True))
                m = may_link(*size, np.minimum(p_a, p_b).sum(1, dtype=np.int64), num, den)
                yield c.select(["a", "b"]).filter(pa.array(m))

    e = common.staged(e.mapInArrow(bounded, "a long, b long"), "near-bounded")
    need = e.select(F.col("a").alias("node")).unionByName(e.select(F.col("b").alias("node"))).distinct()
    texts = docs.join(reps.select("node", "doc_id", "h1").join(need, "node", "left_semi"), "doc_id")

    def own_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = np.array([int(s.sum(dtype=np.uint64).astype(np.int64)) for _, found in sets_of(b.column(1), n) for s in found], np.int64)
            yield b.select(["node", "text"]).filter(pa.array(own == b.column(2).to_numpy()))

    if repeats:  # of the rows of an id, the one whose set is the node's
        texts = texts.select("node", "text", "h1").mapInArrow(own_text, "node long, text string")
    texts = texts.select("node", "text").dropDuplicates(["node"])
    e = e.join(texts.select(F.col("node").alias("b"), F.col("text").alias("t_b")), "b")
    e = e.join(texts.select(F.col("node").alias("a"), F.col("text").alias("t_a")), "a").select("a", "b", "t_a", "t_b")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[int, np.ndarray] = {}

        def all_sets(ids: list[int], texts: pa.Array) -> list[np.ndarray]:
            new = {i: k for k, i in enumerate(ids) if i not in last}
            if new:
                found = [s for _, part in sets_of(texts.take(pa.array(list(new.values()))), n) for s in part]
                last.update(zip(new, found, strict=True))
            return [last[i] for i in ids]

        for b in batches:
            for at in range(0, b.num_rows, 256):
                c = b.slice(at, 256)
                hubs = all_sets(c.column(0).to_pylist(), c.column(2))
                others = all_sets(c.column(1).to_pylist(), c.column(3))
                ok = []
                for k, (x, y) in enumerate(zip(hubs, others, strict=True)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(den * both >= num * (len(x) + len(y) - both) and same_words(c.column(2)[k].as_py(), c.column(3)[k].as_py(), n, num, den))
                yield c.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
                if len(last) > 1024:
                    last.clear()
        last.clear()
        caches.give_back()

    return common.staged(e.mapInArrow(exact, "a long, b long"), "near-links")


def components(links: DataFrame) -> DataFrame:
    """doc, comp (the smallest document it can reach) of every document with a link.

    Labels move along links and jump to their label's label until none changes; each round's labels are a table in the shared
    folder.
    """
    both = common.staged(links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct(), "cc-links")
    label = common.staged(both.groupBy(F.col("x").alias("doc")).agg(F.least(F.min("y"), F.first("x")).alias("comp")), "cc-labels")
    while True:
        moved = both.join(label.select(F.col("doc").alias("y"), "comp"), "y").groupBy(F.col("x").alias("doc")).agg(F.min("comp").alias("m"))
        step = label.join(moved, "doc").select("doc", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        jump = label.select(F.col("doc").alias("comp"), F.col("comp").alias("far"))
        new = common.staged(step.join(jump, "comp", "left").select("doc", "old", F.least("comp", F.coalesce("far", "comp")).alias("comp")), "cc-labels")
        if new.where("old <> comp").isEmpty():
            return new.select("doc", "comp")
        label = new.select("doc", "comp")


def near_groups(docs: DataFrame, id_col="doc_id", text_col="text", shingle: int = 3, num: int = 90, den: int = 100, tile: int = TILE, hub_rounds: int = HUB_ROUNDS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest id reachable by links of similarity num / den or more).

    Null or empty text, or one without words, has an empty set and links with nothing. Rows that repeat an id are one document
    of the graph, which has the links of all of them; ``n_shingles`` is each row's own. A row without id has no component and
    links nothing. Texts of any length are read whole. Extra columns are ignored, whatever their names; an empty table gives no
    rows. Ties don't matter: components don't depend on an order. No link is lost: shards, bounds and tiles only leave out pairs
    that can't be linked or are in one component already.
    """
    spark: SparkSession = docs.sparkSession
    common.ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    own = common.staged(signed(rows, frequencies(rows, shingle), shingle, num, den).withColumn("row", F.monotonically_increasing_id()), "near-sets")
    live = own.where("n > 0 and doc_id is not null")
    classes = live.groupBy("n", "h1", "h2").agg(F.min(F.struct("doc_id", "row")).alias("rep"))
    # rows of equal sets are one node, named after the row with the smallest id
    members = common.staged(live.select("doc_id", "n", "h1", "h2").join(classes, ["n", "h1", "h2"]).select("doc_id", "n", F.col("rep.row").alias("node"), F.col("rep.doc_id").alias("least_id")), "near-classes")
    reps = live.join(classes.select(F.col("rep.row").alias("row")), "row", "left_semi").withColumnRenamed("row", "node")
    of_ids = members.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
    repeats = not own.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").isEmpty()
    entries = reps.select(F.posexplode("prefix").alias("pos", "key"), F.col("node").alias("doc"), "n").select("key", "doc", "n", (F.col("n") - F.col("pos")).alias("room"))
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("docs")).where("docs > 1")
    entries = common.staged(entries.join(shared, "key"), "near-entries")
    texts = rows.where("doc_id is not null")
    links = None
    if repeats:  # all nodes of an id are linked with its first
        links = members.join(of_ids.select("doc_id", "a"), "doc_id").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    labelled = entries.withColumn("comp", F.col("doc"))
    for k in range(hub_rounds):
        # from the second round on, for shards that still hold several components and are too large for one leaf
        part = labelled if not k else labelled.join(labelled.where(F.col("docs") > LEAF).groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key"), "key", "left_semi")
        # a document with little of its own, which sorts before the shard's shingle, is in the middle of its group
        rank = F.struct(((F.col("n") - F.col("room")) / F.col("n")).alias("own"), (F.col("doc") if not k else F.xxhash64("doc", F.lit(k))).alias("rank"), "doc", "n", "room", "comp")
        hubs = part.groupBy("key", F.pmod(F.xxhash64("doc", F.lit(k)), F.lit(HUBS if k else 1))).agg(F.min(rank).alias("hub")).select("key", F.col("hub.doc").alias("hub"), F.col("hub.n").alias("n_hub"), F.col("hub.room").alias("r_hub"), F.col("hub.comp").alias("c_hub"))
        fits = (den * F.least("n", "n_hub") >= num * F.greatest("n", "n_hub")) & ((num + den) * F.least("room", "r_hub") >= num * (F.col("n") + F.col("n_hub")))
        near = part.join(hubs, "key").where((F.col("comp") != F.col("c_hub")) & fits)
        found = verified(near.select(F.least("hub", "doc").alias("a"), F.greatest("hub", "doc").alias("b")).distinct(), reps, texts, shingle, num, den, repeats)
        if k and found.isEmpty():
            break
        links = found if links is None else links.unionByName(found)
        comps = components(links)
        labelled = entries.join(comps, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
        labelled = common.staged(labelled, "near-labelled")
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    folded = reps.select("node", "point", "n", "odd").mapInArrow(lambda it: (pa.RecordBatch.from_arrays([b.column(0), fold_point(b.column(1), b.column(2)), b.column(3)], names=["doc", "point", "odd"]) for b in it if b.num_rows), "doc long, point binary, odd binary")
    rest = labelled.join(mixed, "key", "left_semi").join(folded, "doc")
    tiles = F.ceil(F.col("docs") / tile).cast("int")
    rest = rest.withColumn("tiles", tiles).withColumn("own", F.pmod(F.xxhash64("doc"), F.col("tiles")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rest = rest.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("own").alias("side"), "doc", "n", "room", "comp", "point", F.when(F.col("docs") > LEAF, F.col("odd")).alias("odd"))
    rest = rest.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    pairs = shard_candidates(rest, num, den).distinct()
    found = verified(pairs, reps, texts, shingle, num, den, repeats)
    comps = components(links.unionByName(found))
    names = members.groupBy("node").agg(F.min("least_id").alias("least_id")).join(comps, F.col("node") == F.col("doc"))
    least = names.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    names = names.select("node", "comp").join(least, "comp").select("node", "component_id")
    found = members.join(names, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "least_id").alias("component_id"))
    rest = own.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    if repeats:  # a row without words still is a row of its id
        of_id = found.groupBy("doc_id").agg(F.min("component_id").alias("of_id"))
        rest = rest.join(of_id, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("of_id", "component_id").alias("component_id"))
    return found.unionByName(rest)
