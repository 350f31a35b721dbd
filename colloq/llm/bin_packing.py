"""Packing token sequences by minimum bin slack.

Documents are tokenised once and cut into full windows plus one remainder of
fewer tokens. How many remainders there are of each length (a histogram of at
most ``window`` - 1 rows) is all that the packing itself needs: again and
again the longest length left opens a window and a subset-sum dynamic program
over bitsets picks the multiset of other lengths that leaves least slack. The
pattern is then used as often as the counts allow, which uses up a length, so
there are fewer patterns than lengths whatever the corpus holds. Remainders
find their place by their rank within their length, counted in salted parts.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Generations, durable, lean, text_batches

WINDOW = 4096
#: The id that ends each document.
END = 2
#: Words in a generation of a worker's memo.
CACHE = 150_000
#: ASCII marks between a letter and white space or the text's end; an apostrophe may be joined with letters.
ENDS = re.compile(rb"(?<=[a-z])([^a-zA-Z0-9\s'\x80-\xff]+)(?=\s|\Z)")
#: Letters below this (Latin, Greek, Cyrillic) have long had the categories that the pre-tokeniser knows.
PLAIN = "\u0530"
#: The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = dict(zip([b for b in range(256) if b not in _SHOWN], range(256, 512)))
#: Remainders in a salted part of a length, on average, and parts at least.
PART, LEAST_PARTS = 500_000, 64


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def split_words(raw: bytes) -> list[bytes]:
    """Parts of a text whose ids in a row are the text's ids.

    The vocabulary's pre-tokeniser drops white space, lower-cases, and never
    joins a letter with the marks after it. So ASCII letters are lower-cased
    and marks that end a word stand alone, which leaves few distinct parts.
    Texts with combining accents (which lower case may compose) or with the
    special tokens' own strings are left as they are.
    """
    if b"<|" in raw:
        return raw.split()
    if b"\xcc" not in raw and b"\xcd" not in raw:
        raw = raw.lower()
    return ENDS.sub(rb" \1", raw).split()


class _WordIds(Generations):
    """Ids of words, as little-endian bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        vocabulary = Tokenizer.from_file(path)
        self.encode, self.merge = vocabulary.encode, vocabulary.model.tokenize
        super().__init__(self._ids, CACHE)

    def _ids(self, word: bytes) -> bytes:
        """Words of plain letters go to the merges alone; all others through the whole tokeniser."""
        text = word.decode("utf-8", "replace")
        if text.isalpha() and "Σ" not in text:
            if not word.isascii():
                text = unicodedata.normalize("NFC", text)
            letters = text.lower()
            if letters.isalpha() and max(letters) < PLAIN:
                if not word.isascii():
                    letters = letters.encode().decode("latin-1").translate(BYTE_LETTERS)
                ids = [t.id for t in self.merge(letters)]
                return struct.pack(f"<{len(ids)}I", *ids)
        return np.array(self.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _pieces(path: str, window: int, end: int):
    def run(batches):
        ids_of, last = _WordIds(path), np.array([end], "<u4").tobytes()
        for batch in batches:
            doc, start, length, crc, total = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                ids = b"".join([ids_of[w] for w in split_words(raw)]) + last
                n = len(ids) // 4
                for at in range(0, n, window):
                    part = ids[4 * at : 4 * (at + window)]
                    doc.append(doc_id)
                    start.append(at)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(n)
            yield pa.record_batch([pa.array(x, pa.int64()) for x in (doc, start, length, crc, total)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths with the largest total within ``room``, none used more than ``counts`` has."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, times = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            times = min(times, left)
            steps.append((length, times, reach))
            reach |= reach << length * times & mask
            left, times = left - times, 2 * times
        if reach >> room & 1:
            break
    total, taken = reach.bit_length() - 1, {}
    for length, times, before in reversed(steps):
        if not before >> total & 1:
            taken[length] = taken.get(length, 0) + times
            total -= length * times
    return taken


def plan(counts: dict[int, int], window: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns (times used, length -> count) that use up ``counts``."""
    counts, out = dict(counts), []
    while counts:
        first = max(counts)
        rest = counts | {first: counts[first] - 1}
        pattern = fill({k: v for k, v in rest.items() if v}, window - first)
        pattern[first] = pattern.get(first, 0) + 1
        times = min(counts[k] // v for k, v in pattern.items())
        counts = {k: left for k, v in counts.items() if (left := v - times * pattern.get(k, 0))}
        out.append((times, pattern))
    return out


def packed(docs: DataFrame, text_col: str = "text", path: str | None = None, window: int = WINDOW, end: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is a document of the end id alone. Rows that repeat a
    doc_id are documents of their own. Texts of any length are tokenised whole.
    An empty table gives no pieces; other columns are ignored.
    """
    spark = docs.sparkSession
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    texts = text_batches(docs).select(F.col("doc_id").cast("long"), F.col(text_col).cast("string"))
    pieces = durable(texts.mapInArrow(lean(_pieces(path or vocabulary_path(), window, end)), schema).withColumn("piece", F.monotonically_increasing_id()))
    rest = pieces.where(F.col("length") < window)
    counts = {r["length"]: r["n"] for r in rest.groupBy("length").agg(F.count("*").alias("n")).collect()}  # fewer rows than a window has tokens
    ranges, used, sequences = [], {}, 0
    for times, pattern in plan(counts, window):
        offset = 0
        for length in sorted(pattern, reverse=True):
            each, first = pattern[length], used.get(length, 0)
            ranges.append((length, first, first + each * times, each, sequences, offset))
            used[length] = first + each * times
            offset += each * length
        sequences += times
    parts = max(LEAST_PARTS, sum(counts.values()) // PART)
    rest = rest.withColumn("part", F.pmod(F.xxhash64("piece"), F.lit(parts)))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = durable(rest.groupBy("length", "part").agg(F.count("*").alias("n")).select("length", "part", before.alias("base")))
    rank = F.row_number().over(Window.partitionBy("length", "part").orderBy("piece")) - 1
    ranked = rest.withColumn("own", rank).join(bases, ["length", "part"]).withColumn("rank", F.col("own") + F.col("base"))
    table = spark.createDataFrame(ranges, "length long, lo long, hi long, each long, seq long, at long")
    # At most window patterns of fewer than sqrt(2 * window) lengths each, so it is safe to broadcast.
    placed = ranked.join(F.broadcast(table), "length").where("rank >= lo and rank < hi")
    n = F.col("rank") - F.col("lo")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    placed = placed.select(*columns, (F.col("seq") + F.floor(n / F.col("each"))).alias("sequence_id"), (F.col("at") + n % F.col("each") * F.col("length")).alias("offset"))
    full = pieces.where(F.col("length") == window).select(*columns, (F.col("piece") + sequences).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full)


def op9_bin_packing(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
