"""Near duplicates: banded MinHash, sequential Bayesian pruning, exact verification.

1. One pass over the texts gives each document's shingle set as a key, its
   size and its band hashes. Documents with equal sets are one class, which its
   smallest doc_id stands for; only classes go on.
2. Classes that share a band are candidates. First each is compared with one
   partner only, the smallest class among its buckets' first members: that
   links nearly all true groups at a linear cost.
3. Only buckets that still hold several components are compared in full,
   inside tiles of bounded size: signature batches first, where a pair is
   dropped as soon as the posterior probability that its similarity reaches
   the threshold is below ``miss``, then the full sets. A tile returns at most
   a spanning forest of its members, never its pairs.
4. Distributed union-find joins the links to components.

Work that grows with the square of a group is left only in buckets of many
classes that are neither equal nor linked yet; it is done in tiles spread over
the cluster. Sets are compared as sets of 64-bit shingle hashes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, lean, marked, mix, own_columns, shingles_of, text_batches, text_slices, those_of, words_of
from .components import connected_components

#: Words in a shingle; bands and rows of the signature.
WORDS, BANDS, ROWS = 5, 24, 5
HASHES = BANDS * ROWS
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Hashes compared at a time, and the accepted chance to miss a true link at each step.
BATCH, MISS = 24, 1e-6
#: Classes in a tile of a bucket.
TILE = 192

with np.errstate(over="ignore"):
    _MUL = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
    _ADD = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    _SEED = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E6C63D0876A9A47))


def least_matches(n: int, threshold: float, miss: float = MISS) -> int:
    """Fewest of ``n`` equal hashes at which P(similarity >= threshold) is at least ``miss``.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper
    tail is the binomial sum P(Bin(n + 1, threshold) <= m).
    """
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def _sets(texts: pa.Array, k: int):
    """Yields (row, sorted distinct shingle hashes as one array, sizes) for slices of rows."""
    for at, data, offs in text_slices(texts):
        h, _, counts = words_of(data, offs)
        s, many = shingles_of(h, counts, k)
        ends = np.cumsum(many)
        each = [np.unique(s[e - m : e]) for e, m in zip(ends, many)]
        sizes = np.array([len(x) for x in each], np.int64)
        yield at, (np.concatenate(each) if each else s), sizes


def _signatures(shingles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """MinHash values of the non-empty sets: (sets, HASHES) of uint32."""
    sizes = sizes[sizes > 0]
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    out = np.empty((len(sizes), HASHES), np.uint32)
    buffer = np.empty_like(shingles)
    for j in range(HASHES if len(sizes) else 0):
        np.multiply(shingles, _MUL[j], out=buffer)
        np.add(buffer, _ADD[j], out=buffer)
        out[:, j] = np.minimum.reduceat(buffer, starts) >> np.uint64(32)
    return out


def _bands(signatures: np.ndarray) -> np.ndarray:
    """Band keys (sets, BANDS) as signed 64-bit numbers; the band's place is part of the key."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(_SEED, parts.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9FB21C651E98DF25) + parts[:, :, r])
    return key.view(np.int64)


def _digest(k: int):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at, shingles, sizes in _sets(texts, k):
                ends = np.cumsum(sizes)
                keys = [hashlib.blake2b(shingles[e - n : e].tobytes(), digest_size=16).digest() if n else b"" for e, n in zip(ends, sizes)]
                bands = _bands(_signatures(shingles, sizes)) if sizes.any() else np.zeros((0, BANDS), np.int64)
                offs = np.concatenate([[0], np.cumsum((sizes > 0) * BANDS)]).astype(np.int32)
                yield pa.record_batch([ids.slice(at, len(sizes)), pa.array(sizes), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(offs, pa.array(bands.ravel()))], ["doc_id", "n_shingles", "set_key", "bands"])

    return run


def _verifiable(k: int):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at, shingles, sizes in _sets(texts, k):
                sig, ends, own = _signatures(shingles, sizes), np.cumsum(sizes), np.cumsum(sizes > 0) - 1
                rows = [(sig[own[r]].tobytes(), shingles[ends[r] - n : ends[r]].tobytes()) if n else (b"", b"") for r, n in enumerate(sizes)]
                yield pa.record_batch([ids.slice(at, len(sizes)), pa.array([x[0] for x in rows], pa.binary()), pa.array([x[1] for x in rows], pa.binary())], ["doc_id", "sig", "shingles"])

    return run


def _cuts(percent: int, batch: int = BATCH, hashes: int = HASHES) -> list[tuple[int, int]]:
    return [(n, least_matches(n, percent / 100)) for n in range(batch, hashes + 1, batch)]


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(x) + len(y)
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    merged = np.concatenate([x, y])
    merged.sort()
    inter = int((merged[1:] == merged[:-1]).sum())
    return 100 * inter >= percent * (both - inter)


def _likely(x: bytes, y: bytes, cuts: list[tuple[int, int]]) -> bool:
    """Whether two signatures pass every cut; the next batch of hashes is compared only if the last one passed."""
    x, y, at, same = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), 0, 0
    for n, least in cuts:
        same += int(np.count_nonzero(x[at:n] == y[at:n]))
        at = n
        if same < least:
            return False
    return True


def _pairs(percent: int, cuts: list[tuple[int, int]]):
    def run(batches):
        for batch in batches:
            a, b, sa, xa, sb, xb = (batch.column(i).to_pylist() for i in range(6))
            keep = []
            for r in range(len(a)):
                if _likely(sa[r], sb[r], cuts) and _linked(np.frombuffer(xa[r], np.uint64), np.frombuffer(xb[r], np.uint64), percent):
                    keep.append(r)
            yield edge_batch([(a[r], b[r]) for r in keep])

    return run


class _Forest(dict):
    def find(self, x):
        while (up := self.get(x, x)) != x:
            self[x] = self.get(up, up)
            x = up
        return x

    def union(self, x, y) -> bool:
        x, y = self.find(x), self.find(y)
        self[max(x, y)] = min(x, y)
        return x != y


def _tile_links(tile: np.ndarray, comp: np.ndarray, sig: list[bytes], sets: list[bytes], cross: bool, percent: int, cuts) -> list[tuple[int, int]]:
    """Component pairs that a tile's exact links join; ``tile`` tells the two sides of a tile pair apart. Without ``cuts`` no pair is dropped by its signature."""
    left = np.flatnonzero(tile == tile.min()) if cross else np.arange(len(tile))
    right = np.flatnonzero(tile != tile.min()) if cross else left
    if not len(left) or not len(right):
        return []
    size = np.array([len(x) // 8 for x in sets], np.int64)
    alive = comp[left][:, None] != comp[right][None, :]
    alive &= 100 * np.minimum(size[left][:, None], size[right][None, :]) >= percent * np.maximum(size[left][:, None], size[right][None, :])
    if not cross:
        alive &= left[:, None] < right[None, :]
    if cuts:
        m = np.frombuffer(b"".join(sig), np.uint32).reshape(len(sig), -1)
        step = cuts[0][0]
        same = np.zeros((len(left), len(right)), np.int16)
        for j in range(step):
            same += m[left, j][:, None] == m[right, j][None, :]
        alive &= same >= cuts[0][1]
    p, q = np.nonzero(alive)
    p, q = left[p], right[q]
    count = None
    for n, least in cuts[1:]:
        if not len(p):
            return []
        more = (m[p, n - step : n] == m[q, n - step : n]).sum(1)
        count = more + ((m[p, :step] == m[q, :step]).sum(1) if count is None else count)
        ok = count >= least
        p, q, count = p[ok], q[ok], count[ok]
    if not len(p):
        return []
    if count is not None:
        best = np.argsort(-count, kind="stable")
        p, q = p[best], q[best]
    used = np.unique(np.concatenate([p, q]))
    arrays = {int(i): np.frombuffer(sets[i], np.uint64) for i in used}
    forest, out = _Forest(), []
    if len(p) > 4 * len(used):
        # Many survivors: all intersections of the rows used, by one product of 0/1 matrices in column blocks.
        place = {int(i): r for r, i in enumerate(used)}
        _, inverse, often = np.unique(np.concatenate(list(arrays.values())), return_inverse=True, return_counts=True)
        rows = np.repeat(np.arange(len(used)), [len(x) for x in arrays.values()])
        # A shingle of one row is in no intersection; the others are sorted, so a block of columns is a slice.
        shared = often > 1
        rows, inverse = rows[shared[inverse]], (np.cumsum(shared) - 1)[inverse[shared[inverse]]]
        by = np.argsort(inverse, kind="stable")
        rows, inverse, columns = rows[by], inverse[by], int(shared.sum())
        inter = np.zeros((len(used), len(used)), np.float32)
        for lo in range(0, columns, 8192):
            own = slice(*np.searchsorted(inverse, [lo, lo + 8192]))
            dense = np.zeros((len(used), min(8192, columns - lo)), np.float32)
            dense[rows[own], inverse[own] - lo] = 1
            inter += dense @ dense.T
        many = size[used]
        at, to = np.array([place[int(i)] for i in p]), np.array([place[int(i)] for i in q])
        both = inter[at, to]
        ok = 100.0 * both.astype(np.float64) >= percent * (many[at] + many[to] - both).astype(np.float64)
        for x, y in zip(comp[p[ok]].tolist(), comp[q[ok]].tolist()):
            if forest.union(x, y):
                out.append((x, y))
        return out
    for i, j in zip(p.tolist(), q.tolist()):
        x, y = int(comp[i]), int(comp[j])
        if forest.find(x) != forest.find(y) and _linked(arrays[i], arrays[j], percent):
            forest.union(x, y)
            out.append((x, y))
    return out


def tiles_links(percent: int, cuts: list[tuple[int, int]], unpack: Callable):
    """Rows (key, ta, tb, tile, comp, body...) sorted by (key, ta, tb): a group may span batches. ``unpack`` gives bodies' signatures and sets."""

    def links(rows):
        tile, comp = np.array([r[3] for r in rows]), np.array([r[4] for r in rows], np.int64)
        if comp.min() == comp.max():
            return []
        sig, sets = unpack([r[5:] for r in rows])
        return _tile_links(tile, comp, sig, sets, rows[0][1] != rows[0][2], percent, cuts)

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][:3] != row[:3]:
                    out += links(held)
                    held = []
                held.append(row)
            yield edge_batch(out)
        if held:
            yield edge_batch(links(held))

    return run


def edge_batch(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])


def near_duplicates(docs: DataFrame, text_col: str = "text", words: int = WORDS, percent: int = PERCENT, tile: int = TILE) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Words are runs of other than ASCII white space, A-Z in lower case. A text
    of fewer words than a shingle has its whole sequence as its one shingle;
    null, empty and blank texts have none and link with nothing. Rows that
    repeat a doc_id form one document as far as links go. A null doc_id has a
    null component_id and is kept. Other columns are ignored; no rows give no rows.
    """
    texts = text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    digest = durable(texts.mapInArrow(lean(_digest(words)), "doc_id long, n_shingles long, set_key binary, bands array<long>"))
    classes = durable(digest.where("n_shingles > 0 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands")))
    labels = _components_of(texts, classes, words, percent, tile)
    named = durable(classes.select("set_key", "rep").join(labels, F.col("rep") == F.col("node"), "left").select("set_key", F.coalesce("component", "rep").alias("component")))
    out = digest.join(named, "set_key", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _components_of(texts: DataFrame, classes: DataFrame, words: int, percent: int, tile: int) -> DataFrame:
    """(node, component) over the classes that share a band with another."""
    members = bucket_members(classes.select("rep", F.explode("bands").alias("key")))
    own = those_of(texts, members.select(F.col("rep").alias("doc_id")), "doc_id").dropDuplicates(["doc_id"])
    bodies = durable(own.mapInArrow(lean(_verifiable(words)), "doc_id long, sig binary, shingles binary").withColumnRenamed("doc_id", "rep"))
    cuts = _cuts(percent)
    unpack = lambda rows: ([r[0] for r in rows], [r[1] for r in rows])
    first = durable(members.where("rep != lead").groupBy(F.col("rep").alias("a")).agg(F.min("lead").alias("b")))
    return banded_components(members, first, bodies, _pairs(percent, cuts), tiles_links(percent, cuts, unpack), tile)


def bucket_members(bands: DataFrame) -> DataFrame:
    """(key, size, lead, rep) of the buckets with several members, from ``bands`` (key, rep), where a pair may repeat.

    Buckets with the same members are one bucket; the lead is its least member.
    """
    hot = durable(bands.groupBy("key").agg(F.min("rep").alias("lead"), F.max("rep").alias("top")).where("lead != top").select("key", "lead"))
    every = durable(marked(bands, hot, "key").join(hot, "key").select("key", "lead", "rep").distinct())
    same = every.groupBy("key").agg(F.count("*").alias("size"), F.min("lead").alias("first"), F.bit_xor(F.xxhash64("rep")).alias("print"))
    same = durable(same.groupBy("size", "first", "print").agg(F.min("key").alias("key")).select("key", "size"))
    return durable(every.join(same, "key"))


def banded_components(members: DataFrame, first: DataFrame, bodies: DataFrame, pairs: Callable, tiles: Callable, tile: int) -> DataFrame:
    """(node, component) over the members of buckets (:func:`bucket_members`) and the ends of pairs.

    The pairs ``first`` (a, b) are verified before buckets are compared in
    full. ``bodies`` has (rep, body...) for each member and each end. ``pairs`` verifies rows
    (a, b, a's body..., b's body...), ``tiles`` those of :func:`tiles_links`;
    both are Arrow functions that return links (a, b).
    """
    body = [c for c in bodies.columns if c != "rep"]
    side = lambda name: bodies.select(F.col("rep").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in body])
    near = first.join(side("a"), "a").join(side("b"), "b").select("a", "b", *[f"{c}_{name}" for name in "ab" for c in body])
    labels = durable(connected_components(near.mapInArrow(lean(pairs), "a long, b long")))
    # What is left: buckets with more than one component.
    placed = durable(members.join(labels, F.col("rep") == F.col("node"), "left").select("key", "size", "rep", F.coalesce("component", "rep").alias("comp")))
    # Of buckets with the same members one is enough.
    summary = [F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("n"), F.min("rep").alias("r"), F.bit_xor(F.xxhash64("rep")).alias("print")]
    mixed = placed.groupBy("key").agg(*summary).where("x != y")
    mixed = durable(mixed.groupBy("n", "r", "print").agg(F.min("key").alias("key")).select("key"))
    n = F.ceil(F.col("size") / tile).cast("int")
    left = placed.join(mixed, "key").withColumn("tile", F.pmod(F.xxhash64("rep", F.lit(7)), n).cast("int"))
    left = left.select("key", "rep", "comp", "tile", F.explode(F.sequence(F.lit(0), n - 1)).alias("other"))
    left = left.select("key", F.least("tile", "other").alias("ta"), F.greatest("tile", "other").alias("tb"), "tile", "comp", "rep")
    left = left.join(bodies, "rep").select("key", "ta", "tb", "tile", "comp", *body)
    left = left.repartition("key", "ta", "tb").sortWithinPartitions("key", "ta", "tb")
    more = durable(connected_components(left.mapInArrow(lean(tiles), "a long, b long")).withColumnRenamed("component", "root"))
    nodes = members.select("rep").unionByName(first.select(F.col("a").alias("rep"))).unionByName(first.select(F.col("b").alias("rep"))).distinct().join(labels, F.col("rep") == F.col("node"), "left").select(F.col("rep").alias("n"), F.coalesce("component", "rep").alias("c"))
    return durable(nodes.join(more, F.col("c") == F.col("node"), "left").select(F.col("n").alias("node"), F.coalesce("root", "c").alias("component")))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those that another document stands for, with their own columns.

    The threshold is op8's (PERCENT). Rows with null, empty and blank texts and
    rows without doc_id all stay; rows that repeat a doc_id go or stay together.
    No rows give no rows.
    """
    gone = durable(near_duplicates(docs).where("not kept").select("doc_id").distinct())
    return docs.join(gone, docs["doc_id"] == gone["doc_id"], "left_anti").select(own_columns(docs))


def op8_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
