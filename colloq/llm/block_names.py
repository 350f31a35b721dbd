"""Exact duplicates by deterministic block naming (DataFrame functions only).

White space is deleted, the rest is cut into blocks of a fixed number of code
points, and the distinct blocks are sorted into integer names: a block's name
is made of its sort bucket and its rank there. Then neighbouring names are
paired, distinct pairs are sorted into names again, and so on, until each
document has one name. Names are ranks of full contents, never hashes, so two
documents share an identity exactly when their normalised texts are equal.

Scale: the text crosses the network once, as distinct blocks (copies are
combined before the shuffle). Documents find their blocks' names by a 64-bit
fingerprint; where two different blocks share one, the block itself decides.
All later rounds move integers, half as many each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, durable, numbered, own_columns, unused

#: Code points in a block.
BLOCK = 4096
#: A name is rank * _BUCKETS + bucket; buckets only spread the sort.
_BUCKETS = 1 << 20


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")


def _blocks(text: Column, size: int) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % size), F.lit(0))


def _buckets(df: DataFrame) -> int:
    """Sort buckets, several for each shuffle partition."""
    return min(_BUCKETS, 16 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _named(rows: DataFrame, spread: str, order: list[str], n: int) -> DataFrame:
    """Adds ``name``, from the row's bucket and its rank among the bucket's sorted rows, and ``twin``.

    ``spread`` is a column of hashes; twin tells that other contents share its value.
    """
    rows = rows.withColumn("_bucket", F.pmod(F.col(spread), F.lit(n)).cast("long"))
    w = Window.partitionBy("_bucket").orderBy(spread, *order)
    twin = (F.lag(spread).over(w).eqNullSafe(F.col(spread))) | (F.lead(spread).over(w).eqNullSafe(F.col(spread)))
    return rows.withColumns({"name": F.row_number().over(w).cast("long") * F.lit(_BUCKETS) + F.col("_bucket"), "twin": twin}).drop("_bucket")


def document_identities(docs: DataFrame, text_col: str = "text", block: int = BLOCK, row_id: Column | None = None) -> DataFrame:
    """One row per input row: row_id, the columns of ``docs``'s digest and its identity (level, name).

    Columns: row_id, doc_id, n_points, text_sha256, level, name. Empty and
    null texts have level 0 and name 0. ``row_id`` is a stored id of the rows;
    without it ids are made, which cannot be joined back to ``docs``.
    """
    norm = normalised(F.col(text_col))
    n = _buckets(docs)
    row = F.monotonically_increasing_id() if row_id is None else row_id
    text = docs.select(row.alias("row_id"), "doc_id", F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_points"), norm.alias("norm"))
    # The reference of each document to its blocks, without the text.
    refs = durable(
        text.select(
            "row_id",
            "doc_id",
            "n_points",
            F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
            F.transform(_blocks(F.col("norm"), block), lambda b: F.xxhash64(b)).alias("prints"),
        )
    )
    # Names of the distinct blocks; ``print`` is not trusted to be unique.
    distinct = text.select(F.explode(_blocks(F.col("norm"), block)).alias("block")).distinct()
    names = durable(_named(distinct.withColumn("print", F.xxhash64("block")), "print", ["block"], n).select("print", "name", F.when(F.col("twin"), F.col("block")).alias("block")))
    parts = refs.select("row_id", F.posexplode("prints").alias("seq", "print"))
    placed = parts.join(names.where("block is null").select("print", "name"), "print").select("row_id", "seq", "name")
    clashes = names.where("block is not null")
    if clashes.limit(1).count():
        # Clashing prints are looked up by content; the row is found by its digest.
        texts = text.select(F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), F.posexplode(_blocks(F.col("norm"), block)).alias("seq", "block"))
        texts = texts.distinct().join(clashes.select("block", "name"), "block").select("text_sha256", "seq", "name")
        placed = placed.unionByName(refs.select("row_id", "text_sha256").join(texts, "text_sha256").select("row_id", "seq", "name"))
    return refs.drop("prints").join(_recursive(placed, n), "row_id", "left").select(
        "row_id", "doc_id", "n_points", "text_sha256", F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("name", F.lit(0).cast("long")).alias("name")
    )


def _recursive(placed: DataFrame, n: int) -> DataFrame:
    """(row_id, level, name) from (row_id, seq, name): pairs are named until one name is left."""
    done: DataFrame | None = None
    level = 1
    while True:
        chains = durable(placed.groupBy("row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "name"))), lambda x: x["name"]).alias("names")))
        short = chains.where(F.size("names") == 1).select("row_id", F.lit(level).alias("level"), F.col("names")[0].alias("name"))
        done = short if done is None else done.unionByName(short)
        rest = chains.where(F.size("names") > 1)
        if not rest.limit(1).count():
            return done
        at = F.sequence(F.lit(0), F.floor((F.size("names") - 1) / 2).cast("int"))
        pair = F.transform(at, lambda i: F.struct(i.alias("seq"), F.col("names")[2 * i].alias("p"), F.coalesce(F.try_element_at("names", 2 * i + 2), F.lit(-1).cast("long")).alias("q")))
        pairs = rest.select("row_id", F.inline(pair))
        names = durable(_named(pairs.select("p", "q").distinct().withColumn("print", F.xxhash64("p", "q")), "print", ["p", "q"], n).select("p", "q", "name"))
        placed = pairs.join(names, ["p", "q"]).select("row_id", "seq", "name")
        level += 1


def exact_duplicates(docs: DataFrame, text_col: str = "text", block: int = BLOCK, row_id: Column | None = None) -> DataFrame:
    """One row per input row with the row that stays for it.

    Columns: doc_id, keep_id, group_size, kept, text_sha256. Texts are equal
    when equal without white space; the row with the most code points stays,
    then the smallest doc_id (null last), then the first row read. Null and
    empty texts form one group; rows that repeat a doc_id are separate rows of
    one group. An empty table gives an empty result; other columns are ignored.
    """
    ids = durable(document_identities(docs, text_col, block, row_id))
    order = F.struct((-F.col("n_points")).alias("l"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("keep_id"), F.col("row_id").alias("keep_row"))
    groups = durable(ids.groupBy("level", "name").agg(F.min(order).alias("k"), F.count("*").alias("group_size")).select("level", "name", "k.keep_id", "k.keep_row", "group_size"))
    return ids.join(groups, ["level", "name"]).select("doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), "text_sha256", "row_id")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns, whatever their names.

    Rows with null, empty and blank texts are one group, of which one row
    stays; so it is with rows that are equal in all columns. No rows, no rows.
    """
    row = unused(docs, "_row")
    own = numbered(docs, row)
    gone = durable(exact_duplicates(own, row_id=F.col(row)).where("not kept").select(F.col("row_id").alias(row)))
    return own.join(gone, row, "left_anti").select(own_columns(docs))


ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM n
WINDOW w AS (PARTITION BY norm ORDER BY n_points DESC, doc_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row_id")

