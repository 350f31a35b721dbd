"""Quality rules: fixed limits, then robust outliers by language and source (DataFrame functions only).

Each text gives a vector of transformed statistics. For each language and
source a minimum-covariance-determinant estimate is found by concentration
steps: distances under the present estimate, the ``SHARE`` of rows with the
least, their mean and covariance, and again until the determinants settle.
Three deterministic starts are followed (all rows, the medians, the medians
with the lower quartiles of the faults) and the least determinant is taken.
A row is rejected when its squared Mahalanobis distance is beyond ``CUT``.

There is no least size of a group: each estimate counts ``PRIOR`` rows of its
language's estimate besides its own core, each language's as many of that of
all rows, and that one as many of ``SPREAD`` around the medians. A group of
thousands of rows is its own judge, a group of a few is judged by its language.
The estimate breaks down when more than 1 - SHARE, a quarter, of the rows of a
group are alike in their faults: then they are its core.

Scale: the texts are read once. A step is one grouped sum over (start, group,
distance bin), combined before the shuffle, so a group that holds a third of
all rows costs a few thousand rows; the quantile is read off the bins exactly
alike in every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import NOT_SPACE, SPACE, durable

SYMBOLS = r"[^#*$%&|<>]+"
#: Share of a group that its estimate rests on, and the factor that makes it consistent
#: for normal rows: SHARE / P(chi2(7) <= the SHARE quantile of chi2(5)).
SHARE, CONSISTENT = 0.75, 1.412
#: The largest squared distance that is kept: the 0.975 quantile of chi2(5).
CUT = 12.83
#: Least standard deviations. Length and word length vary in every group, so theirs only keep the matrix
#: invertible. Symbols, repeated lines and repeated words are zero in most rows and constant in the core:
#: there the floor is the scale, or one repeated window would reject a row.
FLOORS = (0.01, 0.01, 0.04, 0.2, 0.15)
#: Rows that the estimate above counts for, and the standard deviations around the medians at the top.
PRIOR, SPREAD = 40.0, (1.0, 0.15, 0.04, 0.2, 0.15)
#: Concentration steps at most, for the groups and for the estimates that are only lent to them.
STEPS, LENT_STEPS = 12, 4
P = len(FLOORS)
_PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
_BINS = 100.0


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a lambda's argument is not expanded again."""
    return F.transform(F.array(value), body)[0]


def _covered(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    Windows are sorted by 40 bits of a hash (33 in texts beyond 16 million words)
    with their place; only those that share them go on and are compared as words, so the count is exact.
    """

    def near(s, bits):
        def twin(x, k):
            like = lambda y: F.coalesce(F.call_function("shiftright", x.bitwiseXOR(y), bits) == 0, F.lit(False))
            return like(F.get(s, k - 1)) | like(F.get(s, k + 1))

        return F.filter(s, twin)

    def exact(s):
        same = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
        return F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)))

    def count(w):
        bits = F.when(F.size(w) <= 1 << 24, 24).otherwise(31)  # an array holds at most 2**31 words
        packed = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.call_function("shiftleft", F.xxhash64(w[i], w[i + 1], w[i + 2]), bits).bitwiseOR(i.cast("long")))
        place = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        likely = F.transform(_bound(F.sort_array(packed), lambda s: near(s, bits)), lambda x: x.bitwiseAND(place).cast("int"))
        windows = F.transform(likely, lambda i: F.struct(w[i].alias("a"), w[i + 1].alias("b"), w[i + 2].alias("c"), i.alias("i")))
        places = F.sort_array(F.transform(_bound(F.sort_array(windows), exact), lambda x: x["i"]))
        steps = lambda p: F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(x - F.get(p, k - 1), F.lit(3))))
        total = F.aggregate(_bound(places, steps), F.lit(0), lambda acc, x: acc + x)
        return F.when(F.size(w) >= 3, total).otherwise(0)

    return _bound(words, count)


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, lang, source and the counts of each row's whole text; null is empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    bare = F.btrim(F.col("t"), F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE + "+"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(NOT_SPACE))
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("t"))
    return rows.select(
        "doc_id", "lang", "source",
        _bound(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _covered(w).cast("long").alias("n_repeat_words"))).alias("w"),
        F.length(F.regexp_replace("t", SPACE + "+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", SYMBOLS, "")).cast("long").alias("n_symbols"),
        _bound(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
    ).select("doc_id", "lang", "source", "w.*", "word_chars", "n_symbols", "l.*")


def _vector() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    share = lambda a, b: F.asin(F.sqrt(F.least(F.col(a) / F.greatest(F.col(b), F.lit(1)), F.lit(1.0))))
    return [F.log1p("n_words"), F.log1p(F.col("word_chars") / n), share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")]


_SUMS = [f"s{i}" for i in range(P)] + [f"q{i}{j}" for i, j in _PAIRS]
_FORM = [f"m{i}" for i in range(P)] + [f"l{i}{j}" for i, j in _PAIRS]


def _estimate(sums: DataFrame) -> DataFrame:
    """(start, key) with means m0.., the Cholesky factor l00.. of the covariance with floors, and its log determinant."""
    out = sums.select("start", "key", *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(P)], *[(F.col(f"q{i}{j}") / F.col("n")).alias(f"q{i}{j}") for i, j in _PAIRS])
    for i, j in _PAIRS:
        cov = (F.col(f"q{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) * CONSISTENT
        cov = F.greatest(cov, F.lit(FLOORS[i] ** 2)) if i == j else cov
        for k in range(j):
            cov = cov - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(cov, F.lit(1e-12))) if i == j else cov / F.col(f"l{j}{j}"))
    det = sum((F.log(F.col(f"l{i}{i}")) for i in range(1, P)), F.log("l00"))
    return out.select("start", "key", *_FORM, det.alias("logdet"))


def _distance(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution; a row for each estimate of its key."""
    out = rows.join(estimate, "key", "left")
    for i in range(P):
        y = F.col(f"f{i}") - F.col(f"m{i}")
        for k in range(i):
            y = y - F.col(f"l{i}{k}") * F.col(f"y{k}")
        out = out.withColumn(f"y{i}", y / F.col(f"l{i}{i}"))
    return out.withColumn("d2", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, P)), F.col("y0") * F.col("y0")))


def _moments() -> list[Column]:
    return [F.count("*").alias("n"), *[F.sum(f"f{i}").alias(f"s{i}") for i in range(P)], *[F.sum(F.col(f"f{i}") * F.col(f"f{j}")).alias(f"q{i}{j}") for i, j in _PAIRS]]


def _added() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("n", *_SUMS)]


def _quartiles(rows: DataFrame) -> DataFrame:
    """(key, a0.., b0.., c0..): quartiles of each statistic, from mergeable sketches of bounded size."""
    cut = rows.groupBy("key").agg(*[F.percentile_approx(f"f{i}", [0.25, 0.5, 0.75], 2000).alias(f"p{i}") for i in range(P)])
    return cut.select("key", *[F.col(f"p{i}")[k].alias(f"{name}{i}") for i in range(P) for k, name in enumerate("abc")])


def _starts(quartiles: DataFrame) -> DataFrame:
    """(start, key) with independent statistics of the quartiles' spread: start 1 at the medians, start 2 at the faults' lower quartiles."""
    scale = [F.greatest((F.col(f"c{i}") - F.col(f"a{i}")) / 1.349, F.lit(FLOORS[i])) for i in range(P)]
    factor = [(scale[i] if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i, j in _PAIRS]
    det = sum((F.log(x) for x in scale[1:]), F.log(scale[0])).alias("logdet")
    at = lambda low: [F.col(f"a{i}" if low and i >= 2 else f"b{i}").alias(f"m{i}") for i in range(P)]
    one = quartiles.select(F.lit(1).alias("start"), "key", *at(False), *factor, det)
    return one.unionByName(quartiles.select(F.lit(2).alias("start"), "key", *at(True), *factor, det))


def ordinary(rows: DataFrame) -> DataFrame:
    """(key, s0.., q00..): moments of a row around the medians of all rows with the spread SPREAD, under the key ''."""
    q = _quartiles(rows.withColumn("key", F.lit("")))
    second = [(F.col(f"b{i}") * F.col(f"b{j}") + (SPREAD[i] ** 2 if i == j else 0.0)).alias(f"q{i}{j}") for i, j in _PAIRS]
    return q.select("key", *[F.col(f"b{i}").alias(f"s{i}") for i in range(P)], *second)


def minimum_determinant(rows: DataFrame, above: DataFrame, steps: int = STEPS) -> tuple[DataFrame, DataFrame]:
    """(estimates, moments) for the keys of ``rows`` (key, up, f0..), by concentration steps from three starts.

    ``above`` has the moments of one row for each ``up``; PRIOR of them are
    added to every core. The estimates are (key, means, factor), the moments
    (key, s0.., q00..) those of one row of the core that was taken.
    """
    keys = durable(rows.groupBy("key").agg(F.any_value("up").alias("up"), F.count("*").alias("all")))
    lent = durable(keys.join(above.withColumnRenamed("key", "up"), "up").select("key", *[F.col(c).alias("p" + c) for c in _SUMS]))

    def pooled(sums: DataFrame) -> DataFrame:
        return sums.join(lent, "key").select("start", "key", (F.col("n") + PRIOR).alias("n"), *[(F.col(c) + PRIOR * F.col("p" + c)).alias(c) for c in _SUMS])

    whole = pooled(rows.groupBy("key").agg(*_moments()).withColumn("start", F.lit(0)))
    estimate, before, sums = durable(_estimate(whole).unionByName(_starts(_quartiles(rows)))), None, None
    w = Window.partitionBy("start", "key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    for _ in range(steps):
        bins = F.floor(F.log1p(F.least("d2", F.lit(1e6))) * _BINS).cast("int")
        held = durable(_distance(rows.drop("up"), estimate).withColumn("bin", bins).groupBy("start", "key", "bin").agg(*_moments()))
        earlier = F.coalesce(F.sum("n").over(w), F.lit(0))
        core = held.withColumn("earlier", earlier).join(keys.select("key", "all"), "key").where(F.col("earlier") < SHARE * F.col("all"))
        sums = durable(pooled(core.groupBy("start", "key").agg(*_added())))
        estimate = _estimate(sums)  # a row for each start and key, worked out anew where it is joined
        now = estimate.agg(F.sum("logdet")).first()[0]
        if now is None or (before is not None and abs(now - before) < 1e-6 * (1 + abs(now))):
            break
        before = now
    best = estimate.groupBy("key").agg(F.min_by(F.struct("start", *_FORM), F.struct("logdet", "start")).alias("e"))
    best = durable(best.select("key", "e.*"))
    one = sums.join(best.select("key", "start"), ["key", "start"]).select("key", *[(F.col(c) / F.col("n")).alias(c) for c in _SUMS])
    return best.drop("start"), durable(one)


def rated(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, the counts, base_failed, kept, distance.

    Null and empty texts have no words and fail the base rules. Null languages
    and sources are values of their own. Repeated rows count each time; other
    columns are ignored; an empty table gives an empty result.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    names = {"g2": F.to_json(F.array("lang", "source")), "g1": F.to_json(F.array("lang"))}
    stats = durable(statistics(docs, text_col).withColumn("base_failed", failed).withColumns(names).withColumns({f"f{i}": f for i, f in enumerate(_vector())}))
    passed, own = stats.where("not base_failed"), [f"f{i}" for i in range(P)]
    _, above = minimum_determinant(passed.select(F.lit("").alias("key"), F.lit("").alias("up"), *own), durable(ordinary(passed)), LENT_STEPS)
    _, above = minimum_determinant(passed.select(F.col("g1").alias("key"), F.lit("").alias("up"), *own), above, LENT_STEPS)
    estimate, _ = minimum_determinant(passed.select(F.col("g2").alias("key"), F.col("g1").alias("up"), *own), above)
    out = _distance(stats.withColumnRenamed("g2", "key"), estimate).withColumn("distance", F.when(~F.col("base_failed"), F.sqrt("d2")))
    kept = ~F.col("base_failed") & (F.col("distance") <= CUT**0.5)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce(kept, F.lit(False)).alias("kept"), "distance", "lang", "source")


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    return rated(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("lang", "source")
