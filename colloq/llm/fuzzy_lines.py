"""Fuzzy duplicate lines by MinHash over character shingles.

Lines are compared as sets of character 5-grams. One pass gives each line a
128-bit key of its text and each distinct text a one-permutation MinHash
signature (one hash for each shingle, the least in each bin), which is banded
for candidates. Every candidate is verified by its exact Jaccard similarity,
and distributed union-find joins them; the first line of each component stays.
Equal lines are one node from the start. Before texts are fetched, pairs go
whose sets differ too much in size, and pairs of long lines of whose HASHES
hashes over UNLIKE differ in their top PLANES bits: at a similarity of 0.8
eleven differ on average, with a deviation of three, so about one pair in
100,000 is lost. Hashes of a short line repeat one another (empty bins borrow),
so lines under LONG shingles are never judged by their signature. Lines of a
bucket are first compared with its lead; of those of a bucket of one tile at
most, the texts are compared further only if another line is likely too.

Scale: band rows of two numbers are the largest table that is shuffled. Keys
that a fixed share of the lines has in common are found on a hashed sixty-fourth
of the lines and never shuffled, so no task gathers a frequent key. Texts of
candidates alone are shuffled once more, as text (a set of hashes would take
eight times as much).

This operator does not use DataFrame functions alone: hashing every character
shingle with SQL functions costs more CPU time than the whole operator may take
(the README has the figures), so signatures are made with numpy in Arrow batches.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bayes_dedup import _linked, banded_components, edge_batch, tiles_links
from .common import Generations, durable, forget, lean, marked, mix, release, text_batches

#: Characters in a shingle; bands and rows of the signature; links need 100 * intersection >= PERCENT * union.
CHARS, BANDS, ROWS, PERCENT, TILE = 5, 12, 5, 80, 192
HASHES = BANDS * ROWS
#: Characters of text that numpy handles at once, and texts that a worker remembers to have signed.
AT_ONCE, REMEMBERED = 1 << 15, 200_000
#: Lines on which frequent band keys are looked for (one in so many), and the most such keys.
SAMPLED, MOST_FREQUENT = 64, 2048
#: Shingles from which a signature is evidence, top bits kept of each of its hashes, and how many hashes may differ in them.
LONG, PLANES, UNLIKE = 80, 4, 25
SKETCH = [f"k{k}" for k in range(PLANES)]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_KEEP = np.uint64((1 << 44) - 1)


def _runs(lines: list[str], most: int = AT_ONCE):
    """Slices of ``lines`` of about ``most`` characters, and of under 2**20 lines."""
    at = 0
    while at < len(lines):
        end, size = at, 0
        while end < len(lines) and end - at < 1 << 20 and (end == at or size + len(lines[end]) < most):
            size += len(lines[end])
            end += 1
        yield at, lines[at:end]
        at = end


def _hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(line, hash) of every shingle of non-empty lines, repeats included; a shorter line is one shingle."""
    n = np.array([len(x) for x in lines], np.int64)
    code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    code += np.uint64(1)
    line = np.repeat(np.arange(len(lines), dtype=np.uint64), n)
    if len(code) >= CHARS:
        h = code[: len(code) - CHARS + 1].copy()
        for k in range(1, CHARS):
            h *= _BASE
            h += code[k : len(code) - CHARS + 1 + k]
        whole = line[: len(h)] == line[CHARS - 1 :]
        h, own = mix(h[whole]), line[: len(h)][whole]
    else:
        h, own = np.zeros(0, np.uint64), line[:0]
    short = np.flatnonzero((n < CHARS) & (n > 0))
    if len(short):
        first, tails = np.cumsum(n) - n, []
        for i in short:
            value = int(n[i]) << 32
            for x in code[first[i] : first[i] + n[i]].tolist():
                value = (value * int(_BASE) + x) & 0xFFFFFFFFFFFFFFFF
            tails.append(value)
        h, own = np.concatenate([h, mix(np.array(tails, np.uint64))]), np.concatenate([own, short.astype(np.uint64)])
    return own, h


def _sets(lines: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each line."""
    out: list[np.ndarray] = []
    for _, part in _runs(lines):
        own, h = _hashes(part)
        if (own[1:] < own[:-1]).any():  # lines shorter than a shingle come last
            order = np.argsort(own, kind="stable")
            own, h = own[order], h[order]
        bounds = np.searchsorted(own, np.arange(len(part) + 1, dtype=np.uint64))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            h[a:b].sort()
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
        at = np.concatenate([[0], np.cumsum(fresh)])[bounds].tolist()
        h = h[fresh]
        out += [h[a:b] for a, b in zip(at[:-1], at[1:])]
    return out


def _signed(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, sketch, bands) of non-empty lines: distinct shingles, PLANES words of the signature's top bits, and BANDS keys each.

    One sort of (line, 44 bits of the hash) orders and counts the shingles; the
    first of each bin is its least. An empty bin takes the next full one's
    value, turned by the distance.
    """
    own, h = _hashes(lines)
    packed = np.sort(own << np.uint64(44) | h >> np.uint64(20))
    packed = packed[np.concatenate([[True], packed[1:] != packed[:-1]])]
    line = (packed >> np.uint64(44)).astype(np.int64)
    size = np.bincount(line, minlength=len(lines))
    packed &= _KEEP
    cell = line * HASHES + (packed * np.uint64(HASHES) >> np.uint64(44)).astype(np.int64)
    lead = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    value, full = np.zeros(len(lines) * HASHES, np.uint32), np.zeros(len(lines) * HASHES, bool)
    value[cell[lead]] = (mix(packed[lead]) >> np.uint64(32)).astype(np.uint32)
    full[cell[lead]] = True
    value, full = value.reshape(-1, HASHES), full.reshape(-1, HASHES)
    at = np.where(np.concatenate([full, full], 1), np.arange(2 * HASHES, dtype=np.int16), np.int16(4 * HASHES))
    following = np.minimum.accumulate(at[:, ::-1], 1)[:, ::-1][:, :HASHES]
    far = (following - np.arange(HASHES, dtype=np.int16)).astype(np.uint32)
    sig = np.take_along_axis(value, (following % HASHES).astype(np.int64), 1) + far * np.uint32(0x9E3779B1)
    parts = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _BASE), parts.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9FB21C651E98DF25) + parts[:, :, r])
    places = np.int64(1) << np.arange(HASHES, dtype=np.int64)
    sketch = np.stack([(sig >> np.uint32(31 - k) & np.uint32(1)).astype(np.int64) @ places for k in range(PLANES)], 1)
    return size, sketch, key.view(np.int64)


def _own_lines(text: str | None) -> list[str]:
    """A text's lines; white space at their ends does not count."""
    return [x.strip(" \t\x0b\x0c\r") for x in (text or "").split("\n")]


def _digest(line: str) -> bytes:
    return hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _lines(batches):
    """(doc_id, text) to a row for each line: doc_id, line_no, n_chars, hi, lo, size, the words of the sketch, bands.

    hi and lo are the key of the text, null for a blank line. A text's size,
    sketch and bands come with its first line in a worker, and again when the worker has
    forgotten it; lines without doc_id have none.
    """
    signed = Generations(lambda key: False, REMEMBERED)
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        doc, number, size, keys, fresh, at = [], [], [], [], [], []
        for d, text in zip(ids, texts):
            for i, line in enumerate(_own_lines(text)):
                key = _digest(line) if line else None
                if key and d is not None and not signed[key]:
                    signed[key] = True
                    at.append(len(doc))
                    fresh.append(line)
                doc.append(d)
                number.append(i)
                size.append(len(line))
                keys.append(key)
        n = len(doc)
        if not n:
            continue
        sets, sketch, bands = np.zeros(n, np.int64), np.zeros((n, PLANES), np.int64), np.zeros((n, BANDS), np.int64)
        place = np.array(at, np.int64)
        for lo, part in _runs(fresh):
            own = place[lo : lo + len(part)]
            sets[own], sketch[own], bands[own] = _signed(part)
        whole = np.frombuffer(b"".join(k or b"\0" * 16 for k in keys), "<i8").reshape(-1, 2)
        blank = np.array([k is None for k in keys], bool)
        old = np.ones(n, bool)
        old[place] = False
        offsets = np.concatenate([[0], np.cumsum(~old) * BANDS]).astype(np.int32)
        listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands[~old].ravel()), mask=pa.array(old))
        columns = [pa.array(doc, pa.int64()), pa.array(number, pa.int64()), pa.array(size, pa.int64()), pa.array(whole[:, 0], mask=blank), pa.array(whole[:, 1], mask=blank), pa.array(sets, mask=old), *[pa.array(sketch[:, k], mask=old) for k in range(PLANES)], listed]
        yield pa.record_batch(columns, ["doc_id", "line_no", "n_chars", "hi", "lo", "size", *SKETCH, "bands"])


def _bodies(batches):
    """(text, wanted lines with their keys, again) to (rep, body, again); a line with another key is of another row with the same doc_id."""
    for batch in batches:
        reps, out, marks = [], [], []
        for text, wanted, again in zip(*(c.to_pylist() for c in batch.columns)):
            lines = _own_lines(text)
            for w in wanted:
                line = lines[w["line_no"]] if w["line_no"] < len(lines) else ""
                if line and np.frombuffer(_digest(line), "<i8").tolist() == [w["hi"], w["lo"]]:
                    reps.append(w["node"])
                    out.append(line)
                    marks.append(again)
        yield pa.record_batch([pa.array(reps, pa.int64()), pa.array(out, pa.string()), pa.array(marks, pa.bool_())], ["rep", "body", "again"])


def _pairs(percent: int):
    def run(batches):
        for batch in batches:
            a, b, x, y = (batch.column(i).to_pylist() for i in range(4))
            place: dict[str, int] = {}
            for line in [*x, *y]:
                place.setdefault(line, len(place))
            sets = _sets(list(place))
            yield edge_batch([(p, q) for p, q, u, v in zip(a, b, x, y) if _linked(sets[place[u]], sets[place[v]], percent)])

    return run


def _tiles(percent: int):
    """:func:`tiles_links` on lines: their sets are made for some AT_ONCE * 8 characters of rows, not bucket by bucket."""
    links = tiles_links(percent, [], lambda rows: ([], [r[0] for r in rows]))

    def sets(batches):
        for batch in batches:
            names, lines = batch.schema.names, batch.column(batch.num_columns - 1).to_pylist()
            for at, part in _runs(lines, AT_ONCE * 8):
                own = pa.array([x.tobytes() for x in _sets(part)], pa.large_binary())
                yield pa.record_batch([*batch.slice(at, len(part)).columns[:-1], own], names)

    return lambda batches: links(sets(batches))


def _frequent(lines: DataFrame) -> list[int]:
    """Band keys that a fixed share of the texts has in common, MOST_FREQUENT at most, from a hashed part of the texts."""
    sample = durable(lines.where(f"bands is not null and pmod(lo, {SAMPLED}) = 0").select("lo", "bands"))
    least = max(64, -(-sample.count() * BANDS // MOST_FREQUENT))
    found = sample.select("lo", F.explode("bands").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return [r["key"] for r in found.select("key").collect()]  # MOST_FREQUENT at most


def _candidates(lines: DataFrame, frequent: list[int], percent: int) -> DataFrame:
    """(key, lo): the band keys that several texts have in common, with their texts' keys.

    Band rows are dealt once by key; both the summary of a key and its members
    come from that exchange. A key of two texts whose sets differ too much in
    size links nothing and is left out (sizes are of 44-bit hashes, hence the
    hundredth). Frequent keys stay out of the exchange: all their rows are members.
    """
    rows = lines.where("bands is not null").select("lo", F.col("size").cast("int").alias("size"), F.explode("bands").alias("key"))
    rare = rows.where(~F.col("key").isin(frequent)) if frequent else rows
    dealt = rare.repartition(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")
    of = dealt.groupBy("key").agg(F.min("lo").alias("x"), F.max("lo").alias("y"), F.count("*").alias("n"), F.min("size").alias("s"), F.max("size").alias("t"))
    of = of.where((F.col("x") != F.col("y")) & ((F.col("n") > 2) | (101 * F.col("s").cast("long") >= percent * F.col("t").cast("long"))))
    found = dealt.join(of.select("key").hint("shuffle_hash"), "key").select("key", "lo", "size")
    found = found.unionByName(rows.where(F.col("key").isin(frequent)).select("key", "lo", "size")) if frequent else found
    # Both sides need the same columns and no semi join, which the planner moves below the exchange: else all band rows are dealt twice.
    return durable(found).select("key", "lo")


def _members(found: DataFrame, nodes: DataFrame, frequent: list[int]) -> DataFrame:
    """(key, n, lead, rep) of candidates (key, lo) by node, lead and rep with size and sketch; a rare key's rows meet in one task, a frequent key's are combined before they move."""
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Merged at every size: as a broadcast it would move nothing on small tables only.
    placed = found.join(nodes.select("lo", F.col("node").alias("id"), "size", *SKETCH).hint("merge"), "lo").drop("lo")
    if frequent:
        placed = durable(placed)
    rep = F.struct("id", "size", *SKETCH)
    rare = placed.where(~F.col("key").isin(frequent)) if frequent else placed
    w = Window.partitionBy("key").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = rare.repartition(parts, "key").distinct().select("key", F.count("*").over(w).alias("n"), F.first(rep).over(w).alias("lead"), rep.alias("rep")).where("n > 1")
    if frequent:
        own = durable(placed.where(F.col("key").isin(frequent)).distinct())
        of = own.groupBy("key").agg(F.count("*").alias("n"), F.min(rep).alias("lead"))
        out = out.unionByName(own.join(F.broadcast(of), "key").select("key", "n", "lead", rep.alias("rep")).where("n > 1"))  # MOST_FREQUENT rows at most
    return durable(out)


def _likely(a: str, b: str, percent: int) -> Column:
    """False where the sizes or the signatures of two texts rule their link out."""
    least, most = F.least(f"{a}.size", f"{b}.size"), F.greatest(f"{a}.size", f"{b}.size")
    other = reduce(Column.bitwiseOR, [F.col(f"{a}.{k}").bitwiseXOR(F.col(f"{b}.{k}")) for k in SKETCH])
    return (101 * least >= percent * most) & ((least < LONG) | (F.bit_count(other) <= UNLIKE))


def _unjudged(members: DataFrame, percent: int, tile: int) -> DataFrame:
    """(key, size, rep) of the rows of ``members`` that may link with others than their bucket's lead.

    In a bucket of one tile at most these have a likely partner which is not
    the lead either; larger ones stay whole, so the rows looked at for one are
    under ``tile``.
    """
    small = members.where((F.col("n") > 2) & (F.col("n") <= tile) & (F.col("rep.id") != F.col("lead.id"))).select("key", "n", "rep")
    x, y = small.alias("x"), small.hint("merge").alias("y")
    like = (F.col("x.key") == F.col("y.key")) & (F.col("x.n") == F.col("y.n")) & (F.col("x.rep.id") != F.col("y.rep.id")) & _likely("x.rep", "y.rep", percent)
    found = x.join(y, like, "left_semi").unionByName(members.where((F.col("n") > 2) & (F.col("n") > tile)).select("key", "n", "rep"))
    return durable(found.select("key", F.col("n").alias("size"), F.col("rep.id").alias("rep")))


def fuzzy_lines(docs: DataFrame, text_col: str = "text", percent: int = PERCENT, tile: int = TILE) -> DataFrame:
    """One row per line: doc_id, line_no, n_chars, keep_doc_id, keep_line_no, kept.

    Lines are what lies between line feeds, numbered from 0; a null text is one
    empty line. Blank lines link with nothing and stay. Of a component the line
    with the smallest (doc_id, line_no) stays; rows that repeat a doc_id repeat
    its lines, and repeats of that line stay with it. A null doc_id comes last.
    No rows give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    texts = text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    lines = durable(texts.mapInArrow(lean(_lines), "doc_id long, line_no long, n_chars long, hi long, lo long, size long, " + "".join(f"{k} long, " for k in SKETCH) + "bands array<long>"))
    frequent = _frequent(lines)
    found = _candidates(lines, frequent, percent)
    release(spark)
    # Two texts with one lo are two nodes: lo only finds candidates.
    known = marked(lines.where("doc_id is not null").select("hi", "lo", "doc_id", "line_no", "size", *SKETCH), found, "lo")  # some others stay, as nodes without a bucket
    nodes = known.groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "line_no")).alias("at"), *[F.max(c).alias(c) for c in ("size", *SKETCH)])
    nodes = durable(nodes.withColumn("node", F.monotonically_increasing_id()))
    members = _members(found, nodes, frequent)
    forget(found)
    pairs = durable(members.where((F.col("rep.id") != F.col("lead.id")) & _likely("rep", "lead", percent)).select(F.col("rep.id").alias("a"), F.col("lead.id").alias("b")).distinct())
    placed, members = members, _unjudged(members, percent, tile)
    forget(placed)
    need = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(members.select(F.col("rep").alias("node"))).distinct()
    wanted = nodes.join(need, "node", "left_semi").groupBy("at.doc_id").agg(F.collect_list(F.struct(F.col("at.line_no").alias("line_no"), "hi", "lo", "node")).alias("wanted"))  # a document's own lines
    # Only rows that repeat a doc_id can give a node's text twice; other texts need not move to be told apart.
    again = lines.where("line_no = 0 and doc_id is not null").groupBy("doc_id").agg((F.count("*") > 1).alias("again")).where("again")
    wanted = durable(wanted.join(durable(again), "doc_id", "left").withColumn("again", F.coalesce("again", F.lit(False))))
    release(spark)
    # Merged at every size, here and for the bodies: what large tables need is what small ones show.
    own = texts.where("doc_id is not null").join(wanted.hint("merge"), "doc_id").select("text", "wanted", "again")
    bodies = durable(own.mapInArrow(lean(_bodies), "rep long, body string, again boolean"))
    twice = durable(bodies.where("again").dropDuplicates(["rep"]))
    bodies = bodies.where("not again").unionByName(twice).drop("again").hint("merge")
    release(spark)
    labels = banded_components(members, pairs, bodies, _pairs(percent), _tiles(percent), tile)
    order = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("line_no").alias("l"))
    named = nodes.select("hi", "lo", "node").join(labels, "node").select("hi", "lo", "component")
    first = lines.where("lo is not null").groupBy("hi", "lo").agg(F.min(order).alias("k"), F.count("*").alias("n")).join(named, ["hi", "lo"], "left")
    first = durable(first.where("n > 1 or component is not null").drop("n"))  # any other line stands for itself
    least = first.where("component is not null").groupBy("component").agg(F.min("k").alias("_k"))
    first = first.join(least, "component", "left").select("hi", "lo", F.coalesce("_k", "k").alias("k"))
    out = lines.drop("size", *SKETCH, "bands").join(first, ["hi", "lo"], "left")
    kept = F.col("k").isNull() | (F.col("doc_id").eqNullSafe(F.col("k.d")) & (F.col("line_no") == F.col("k.l")))
    mine = lambda c, own: F.when(F.col("k").isNull(), F.col(own)).otherwise(F.col(f"k.{c}")).alias(f"keep_{own}")
    return out.select("doc_id", "line_no", "n_chars", mine("d", "doc_id"), mine("l", "line_no"), kept.alias("kept"))


def op2_fuzzy_lines(spark, sf_dir: str) -> DataFrame:
    return fuzzy_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
