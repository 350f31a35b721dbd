"""Mixing sources to target weights by entropy balancing.

Each source has a target of tokens. Among all document rates in [0, 2] that
meet a source's target, entropy balancing takes those nearest to "every
document once" in relative entropy: rate = min(2, exp(lambda * size / mean)).
The multipliers solve a convex dual by Newton steps; every step is one grouped
sum over a histogram of sizes, so it is distributed and combines before the
shuffle. Rates become whole copies by error diffusion in small hash chunks of
a source, largest documents first, so that what one document gains or loses
the next ones make up for.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import NOT_SPACE, SPACE, durable, numbered, own_columns, unused

#: Weights dealt to the sources in order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: The mix's size as a share of all sizes, and the most copies of a document.
SHARE, MOST = 1.5, 2
#: Documents in a rounding chunk, on average.
CHUNK = 512
#: Bits of a row's copies in a word of the packed copies, and rows of a word.
COPY_BITS = MOST.bit_length()
IN_WORD = 64 // COPY_BITS
#: Newton steps at most, and the relative residual that ends them.
STEPS, RESIDUAL = 60, 1e-9


def word_count(text: Column) -> Column:
    """Runs of other than ASCII white space; null has none."""
    marks = F.regexp_replace(text, f"{SPACE}*{NOT_SPACE}+{SPACE}*", "x")
    return F.when(F.coalesce(text, F.lit("")).rlike(NOT_SPACE), F.length(marks)).otherwise(0).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, idx, n_docs, source_size, target) from (source, size, n), one row per source.

    The window over sources sees one row for each source. Weights follow the
    sources' order by code point, null last. A target is
    min(most * source_size, weight * level); the level rises until the targets
    add up, which is the resharing of every excess by weight.
    """
    totals = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("idx"), F.lit(len(weights))).cast("int") + 1)
    t = durable(totals.withColumn("idx", rank.cast("long")).withColumn("weight", weight).withColumn("cap", most * F.col("source_size").cast("double")))
    total = share * float(t.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        capped = F.col("cap") < F.col("weight") * F.lit(level)
        spent, open_weight = t.agg(F.sum(F.when(capped, F.col("cap")).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight")))).first()
        if not open_weight or (new := (total - spent) / open_weight) <= level:
            break
        level = new
    return t.select("source", "idx", "n_docs", "source_size", F.least("cap", F.col("weight") * F.lit(level)).alias("target"))


def _rate(lam: Column, z: Column, most: int) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.least(lam * z, F.lit(math.log(most) + 1))))


def tilts(sizes: DataFrame, targets: DataFrame, most: int = MOST) -> DataFrame:
    """Adds ``lam`` and ``mean`` to ``targets``: the dual's solution by safeguarded Newton steps.

    Sources whose target is all they can give have an infinite multiplier.
    """
    t = targets.withColumn("mean", F.col("source_size") / F.greatest("n_docs", F.lit(1))).withColumn("full", F.col("target") >= most * F.col("source_size") * (1 - 1e-12))
    h = durable(sizes.join(t.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).where("size > 0 and not full").select("idx", (F.col("size") / F.col("mean")).alias("z"), "n"))
    lam = durable(t.withColumns({"lam": F.when(F.col("full"), F.lit(float("inf"))).otherwise(0.0), "lo": F.lit(float("-inf")), "hi": F.lit(float("inf"))}))
    for _ in range(STEPS):
        r = _rate(F.col("lam"), F.col("z"), most)
        sums = h.join(lam.select("idx", "lam"), "idx").groupBy("idx").agg(
            F.sum(F.col("n") * F.col("z") * r).alias("s"), F.sum(F.when(r < most, F.col("n") * F.col("z") * F.col("z") * r).otherwise(0.0)).alias("slope")
        )
        gap = F.col("s") - F.col("target") / F.col("mean")
        lo, hi = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")), F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        step = lam.join(sums, "idx", "left").withColumns({"gap": gap, "lo": lo, "hi": hi})
        newton = F.when(F.col("slope") > 0, F.col("lam") - F.col("gap") / F.col("slope"))
        bounded = (F.col("lo") > float("-inf")) & (F.col("hi") < float("inf"))
        beyond = F.col("lam") - F.signum("gap") * (1 + F.abs("lam"))
        fallback = F.when(bounded, (F.col("lo") + F.col("hi")) / 2).otherwise(beyond)
        inside = (newton > F.col("lo")) & (newton < F.col("hi")) & (F.abs(newton - F.col("lam")) <= 4 * (1 + F.abs("lam")))
        moved = F.when(F.coalesce(F.col("gap") == 0, F.lit(True)), F.col("lam")).otherwise(F.when(F.coalesce(inside, F.lit(False)), newton).otherwise(fallback))
        step = durable(step.withColumn("lam", moved).withColumn("off", F.abs("gap") * F.col("mean") / F.greatest(F.col("target"), F.lit(1.0))))
        worst = step.agg(F.max("off")).first()[0] or 0.0
        lam = step.select(*t.columns, "lam", "lo", "hi")
        if worst < RESIDUAL:
            break
    return lam.select(*targets.columns, "mean", "lam")


def _diffuse(group: pd.DataFrame) -> pd.DataFrame:
    """Whole copies, floor or ceiling of each rate, that keep the running error in tokens least."""
    group = group.sort_values(["size", "spread", "doc_id", "row_id"], ascending=[False, True, True, True], kind="stable")
    error, copies = 0.0, []
    for size, rate in zip(group["size"].tolist(), group["rate"].tolist()):
        low = math.floor(rate)
        error += (rate - low) * size
        more = rate > low and error >= 0.5 * size
        error -= size * more
        copies.append(low + more)
    return group[["row_id"]].assign(copies=pd.array(copies, dtype="Int64"))


def mixed(docs: DataFrame, text_col: str = "text", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, chunk: int = CHUNK, row_id: Column | None = None) -> DataFrame:
    """One row per input row: row_id, doc_id, size, source_size, target, copies, taken.

    A null text has size 0; a null source is a source of its own, the last.
    Documents of size 0 take no tokens and stay once. Rows that repeat a doc_id
    are rounded separately. A source without words has target 0. An empty table
    gives an empty result. ``row_id`` is a stored id of the rows; without it
    ids are made, which cannot be joined back to ``docs``.
    """
    row = F.monotonically_increasing_id() if row_id is None else row_id
    rows = durable(docs.select(row.alias("row_id"), F.col("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col(text_col)).alias("size")))
    sizes = durable(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    targets = durable(source_targets(sizes, weights, share, most))
    solved = durable(tilts(sizes, targets, most).withColumnRenamed("source", "s"))
    rate = F.when(F.col("lam") == float("inf"), F.lit(float(most))).otherwise(_rate(F.col("lam"), F.col("size") / F.col("mean"), most))
    rate = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(rate)
    # The table of sources is broadcast only if its written size is below Spark's limit.
    rated = rows.join(solved, F.col("source").eqNullSafe(F.col("s"))).withColumn("rate", rate)
    chunks = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / chunk)).cast("long")
    spread = F.xxhash64("doc_id")
    rated = durable(rated.withColumns({"spread": spread, "chunk": F.pmod(F.shiftrightunsigned(spread, 7), chunks)}).select("row_id", "doc_id", "idx", "chunk", "spread", "size", "rate", "source_size", "target"))
    copies = rated.groupBy("idx", "chunk").applyInPandas(_diffuse, "row_id long, copies long")
    out = rated.join(copies, "row_id").withColumn("taken", F.col("copies") * F.col("size"))
    return out.select("row_id", "doc_id", "size", "source_size", "target", "copies", "taken")


def _shift(row: str) -> str:
    return f"cast({row} % {IN_WORD} AS int) * {COPY_BITS}"


def packed_copies(rows: DataFrame, word: str, bits: str) -> DataFrame:
    """(word, bits) from (row_id, copies): COPY_BITS for each of IN_WORD rows of consecutive ids, words without a copy left out.

    This is a thirtieth of a table by row, so that Spark can broadcast it, and
    keep the texts where they are, for so many more documents.
    """
    of = rows.where("copies > 0").groupBy(F.expr(f"row_id div {IN_WORD}").alias(word))
    return durable(of.agg(F.expr(f"bit_or(shiftleft(copies, {_shift('row_id')}))").alias(bits)))


def mix(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as many times as it is taken, with its own columns, whatever their names.

    Rows of size 0 (null, empty and blank texts) stay once; equal rows are
    rounded separately; a null source is a source. No rows give no rows.
    """
    row, word, bits = unused(docs, "_row"), unused(docs, "_word"), unused(docs, "_bits")
    own = numbered(docs, row)
    copies = packed_copies(mixed(own, row_id=F.col(row)), word, bits)
    many = F.expr(f"cast(shiftrightunsigned({bits}, {_shift(row)}) & {(1 << COPY_BITS) - 1} AS int)")
    taken = own.join(copies, F.expr(f"{row} div {IN_WORD}") == F.col(word))
    return taken.withColumn(word, F.explode(F.array_repeat(F.lit(1), many))).select(own_columns(docs))


def op10_entropy_mixing(spark, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "copies")
