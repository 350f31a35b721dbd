"""Matches with their places in a text, and what is done with overlapping ones.

Spark has no "all matches with offsets"; the texts between matches (split) and
the matches themselves give offsets as running lengths, in one pass each.
Only the running sums of lengths are made in Arrow batches; texts stay where
they are. Offsets are code points from 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType
from pyspark.sql.window import Window

TOKEN = r"[\p{L}\p{N}_\p{M}]+"
SENTENCE_END = r"[.!?؟।]+\s+|\n+"


@F.pandas_udf(ArrayType(IntegerType()))
def _running(lengths: pd.Series) -> pd.Series:
    return lengths.map(lambda x: None if x is None else np.cumsum(x, dtype=np.int32))


def find_all(text: Column, pattern: str) -> Column:
    """Array of (start, end, text) of the matches, left to right; for patterns with few matches in a text."""
    hits = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    none = F.array().cast("array<struct<start:int,end:int,text:string>>")

    def build(h, g):
        seed = F.struct(F.lit(0).alias("at"), none.alias("out"))
        step = lambda acc, i: F.struct(
            (acc["at"] + F.length(g[i]) + F.length(h[i])).alias("at"),
            F.array_append(acc["out"], F.struct((acc["at"] + F.length(g[i])).alias("start"), (acc["at"] + F.length(g[i]) + F.length(h[i])).alias("end"), h[i].alias("text"))).alias("out"),
        )
        return F.aggregate(F.sequence(F.lit(0), F.size(h) - 1), seed, step, lambda acc: acc["out"])

    # a text without a match is not split
    placed = lambda h: F.transform(F.array(F.split(text, pattern, -1)), lambda g: build(h, g))[0]
    return F.transform(F.array(hits), lambda h: F.when(F.size(h) == 0, none).otherwise(placed(h)))[0]


def words(df: DataFrame, text: str = "text", pattern: str = TOKEN, *keep: str) -> DataFrame:
    """One row per token without its place in the text: the kept columns, pos, token."""
    return df.select(*keep, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(f"({pattern})"), F.lit(1))).alias("pos", "token"))


def tokens(df: DataFrame, text: str = "text", pattern: str = TOKEN, *keep: str, ahead: int = 0) -> DataFrame:
    """One row per token: the kept columns, pos, start, end, token; with ``ahead`` also the tokens that follow and their ends as token_1, end_1, ...

    Offsets are running sums over a text's own pieces, so no token is dealt or sorted.
    """
    hits, gaps = F.regexp_extract_all(F.col(text), F.lit(f"({pattern})"), F.lit(1)), F.split(F.col(text), pattern, -1)
    own = df.select(*keep, hits.alias("_h"), gaps.alias("_g"))
    own = own.select(*keep, "_h", _running(F.zip_with("_g", "_h", lambda g, h: F.length(g) + F.coalesce(F.length(h), F.lit(0)))).alias("_e"))
    later = lambda c, i: F.slice(c, i + 1, F.greatest(F.size("_h") - i, F.lit(0)))
    zipped = [later("_e", 0).alias("end"), F.col("_h").alias("token")]
    for i in range(1, ahead + 1):
        zipped += [later("_e", i).alias(f"end_{i}"), later("_h", i).alias(f"token_{i}")]
    rows = own.select(*keep, F.posexplode(F.arrays_zip(*zipped)).alias("pos", "x"))
    more = [F.col(f"x.{name}_{i}") for i in range(1, ahead + 1) for name in ("token", "end")]
    return rows.select(*keep, "pos", (F.col("x.end") - F.length("x.token")).alias("start"), "x.end", "x.token", *more)


def sentence_rows(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row per sentence: the kept columns, start, sentence. Linear in the sentences of a text; blank ones are left out."""
    ends, pieces = F.regexp_extract_all(F.col(text), F.lit(f"({SENTENCE_END})"), F.lit(1)), F.split(F.col(text), SENTENCE_END, -1)
    own = df.select(*keep, ends.alias("_h"), pieces.alias("_g"))
    own = own.select(*keep, "_g", _running(F.zip_with("_g", "_h", lambda g, h: F.length(g) + F.coalesce(F.length(h), F.lit(0)))).alias("_e"))
    rows = own.select(*keep, F.explode(F.arrays_zip(F.concat(F.array(F.lit(0)), F.slice("_e", 1, F.size("_e") - 1)).alias("start"), F.col("_g").alias("g"))).alias("x"))
    return rows.select(*keep, "x.start", F.regexp_replace("x.g", r"(?U)^\s+|\s+$", "").alias("sentence")).where("sentence <> ''")


def sentence_texts(text: Column) -> Column:
    """Array of the sentences without their places."""
    return F.filter(F.transform(F.split(text, SENTENCE_END, -1), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def sentences(text: Column) -> Column:
    """Array of (start, sentence): pieces between sentence ends; blank pieces are left out."""
    ends = find_all(text, SENTENCE_END)

    def cut(e):
        starts = F.concat(F.array(F.lit(0)), F.transform(e, lambda x: x["end"]))
        stops = F.concat(F.transform(e, lambda x: x["start"]), F.array(F.length(text)))
        whole = F.zip_with(starts, stops, lambda s, t: F.struct(s.alias("start"), F.regexp_replace(F.substring(text, s + 1, t - s), r"(?U)^\s+|\s+$", "").alias("sentence")))
        return F.filter(whole, lambda x: x["sentence"] != "")

    return F.transform(F.array(ends), cut)[0]


def context(text: Column, start: Column, end: Column, width: int = 15) -> Column:
    lo = F.greatest(F.lit(0), start - width)
    return F.trim(F.substring(text, lo + 1, F.least(F.length(text), end + width) - lo))


def keep_disjoint(spans: Column, order: Column | None = None) -> Column:
    """Greedy choice from an array of structs with start and end, in the array's order: one is kept if it overlaps none kept."""
    overlaps = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    step = lambda acc, x: F.when(F.exists(acc, lambda y: overlaps(x, y)), acc).otherwise(F.array_append(acc, x))
    return F.aggregate(spans, F.filter(spans, lambda x: F.lit(False)), step)


def disjoint_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """:func:`keep_disjoint` of each key's rows (start, end, ...) in the order of the columns ``order``, which come first in the result.

    Only spans of one island, a run of spans that overlap their neighbours, can
    be in each other's way; the choice is made by island, so its work grows
    with the spans of a text and not with their square.
    """
    before = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    apart = rows.withColumn("_new", F.when(F.col("start") < F.max("end").over(before), 0).otherwise(1)).withColumn("_island", F.sum("_new").over(upto))
    rest = [c for c in rows.columns if c not in keys and c not in order]
    found = F.array_sort(F.collect_list(F.struct(*order, *rest)))
    return apart.groupBy(*keys, "_island").agg(found.alias("_s")).select(*keys, F.inline(keep_disjoint(F.col("_s"))))
