"""Intervals: overlap joins, islands, cuts, frames and diarization error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Length shared; null if a bound is null (least and greatest would skip it)."""
    known = s1.isNotNull() & e1.isNotNull() & s2.isNotNull() & e2.isNotNull()
    return F.when(known, F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2)))


def overlap_join(left: DataFrame, right: DataFrame, key: str, width: float, how: str = "inner") -> DataFrame:
    """Pairs of rows of one key whose [start, end) overlap.

    Both sides are cut into buckets of ``width`` and joined on (key, bucket),
    so a long call is spread over many tasks; a pair is produced in the bucket
    where the later of the two starts. Left columns keep their names, right
    ones get the prefix ``r_``. ``how`` may be "left".
    """
    cut = lambda s, e: F.explode(F.sequence(F.floor(s / width), F.floor(F.greatest(s, e - 1e-9) / width)))
    a = left.withColumn("_lid", F.monotonically_increasing_id()) if how == "left" else left
    wide = a.withColumn("_b", cut(F.col("start"), F.col("end")))
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).withColumn("_rb", cut(F.col("r_start"), F.col("r_end")))
    meets = (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end"))
    first = F.floor(F.greatest("start", "r_start") / width) == F.col("_b")
    pairs = wide.join(b, (F.col(key) == F.col(f"r_{key}")) & (F.col("_b") == F.col("_rb")) & meets & first).drop("_b", "_rb")
    if how != "left":
        return pairs
    rights = [f"r_{c}" for c in right.columns]
    return a.join(pairs.select("_lid", *rights), "_lid", "left").drop("_lid")


def speaker_of_words(words: DataFrame, segments: DataFrame, key: str = "call_id", width: float = 60.0) -> DataFrame:
    """Adds the speaker with the largest overlap (the earliest in a tie) and that overlap; null without one.

    Both sides are cut into buckets of ``width``, so a long call is spread over
    many tasks. Equal rows stay apart; a word without length has no speaker.
    """
    cut = lambda s, e: F.explode(F.sequence(F.floor(s / width), F.greatest(F.floor(s / width), F.ceil(e / width) - 1)))
    own = words.select(F.struct(*words.columns).alias("_word"), F.monotonically_increasing_id().alias("_id"), F.col(key).alias("_k"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    wide = own.withColumn("_b", F.explode_outer(F.when(F.col("_s").isNotNull() & F.col("_e").isNotNull(), F.sequence(F.floor(F.col("_s") / width), F.greatest(F.floor(F.col("_s") / width), F.ceil(F.col("_e") / width) - 1)))))
    seg = segments.where("end > start").select(F.col(key).alias("_rk"), F.col("seg").alias("_seg"), F.col("start").alias("_rs"), F.col("end").alias("_re"), F.col("speaker_id").alias("_sp"), cut(F.col("start"), F.col("end")).alias("_rb"))
    j = wide.join(seg, (F.col("_k") == F.col("_rk")) & (F.col("_b") == F.col("_rb")) & (F.col("_s") < F.col("_re")) & (F.col("_rs") < F.col("_e")), "left")
    shared = overlap(F.col("_s"), F.col("_e"), F.col("_rs"), F.col("_re"))
    found = F.when(F.col("_seg").isNotNull(), F.struct(shared.alias("o"), (-F.col("_seg")).alias("n")))
    best = F.max_by(F.struct("_sp", shared.alias("o")), found)
    return j.groupBy("_id").agg(F.any_value("_word").alias("_word"), best.alias("_best")).select("_word.*", F.col("_best._sp").alias("speaker_id"), F.col("_best.o").alias("overlap"))


def aligned_words(words: DataFrame, spoken: DataFrame, segments: DataFrame, key: str = "call_id", least: float = 0.3) -> DataFrame:
    """Adds speaker_id to words (key, seg of ``spoken``, start, end, ...).

    A word goes to the speaker it overlaps most if that is at least ``least``
    of its length; otherwise to the speaker that its spoken segment (key, seg,
    start, end) overlaps most. Null if neither overlaps anyone.
    """
    by_word = speaker_of_words(words, segments, key).withColumnRenamed("speaker_id", "_own")
    by_segment = speaker_of_words(spoken.select(key, "seg", "start", "end"), segments, key).select(F.col(key).alias("_k"), F.col("seg").alias("_g"), F.col("speaker_id").alias("_other"))
    both = by_word.join(by_segment, (F.col(key) == F.col("_k")) & (F.col("seg") == F.col("_g")), "left")
    length = F.col("end") - F.col("start")
    sure = (length > 0) & (F.coalesce(F.col("overlap"), F.lit(0)) / length >= least)
    return both.select(*words.columns, F.when(sure, F.col("_own")).otherwise(F.col("_other")).alias("speaker_id"))


def event_segments(points: DataFrame, segments: DataFrame, key: str, at: str, start: str = "at", end: str = "until", keep: tuple[str, ...] = ("idx",)) -> DataFrame:
    """Adds to points (key, at) the columns ``keep`` of the segment [start, end) that holds them; null without one.

    Segments of a key must not overlap: the last one that begins at or before a
    point holds it or none does, which a running look-back finds without a range join.
    """
    rows = points.select(F.struct(*points.columns).alias("_pt"), F.col(key).alias("_k"), F.col(at).cast("double").alias("_p"))
    segs = segments.where(F.col(end) > F.col(start)).select(F.col(key).alias("_k"), F.col(start).cast("double").alias("_p"), F.struct(F.col(end).alias("_end"), *keep).alias("_seg"))
    both = rows.withColumn("_seg", F.lit(None).cast(segs.schema["_seg"].dataType)).unionByName(segs.withColumn("_pt", F.lit(None).cast(rows.schema["_pt"].dataType)))
    w = Window.partitionBy("_k").orderBy("_p", F.col("_pt").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("_seg", F.last("_seg", ignorenulls=True).over(w)).where("_pt is not null")
    return placed.select("_pt.*", *[F.when(F.col("_p") < F.col("_seg._end"), F.col(f"_seg.{c}")).alias(c) for c in keep])


def merge_runs(df: DataFrame, key: list[str], same: list[str], gap: float, order: list[str], value: str | None = None, mean: str | None = None, weighted: str | None = None, parts: list[str] | None = None) -> DataFrame:
    """Runs of neighbours that agree in ``same`` and lie at most ``gap`` apart: start of the first, end of the last, count.

    ``value`` is joined with spaces, ``mean`` averaged, ``weighted`` averaged by
    duration, and ``parts`` gathered in order as ``words``.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    joined = (F.col("start") - F.lag("end").over(w)) <= gap
    for c in same:
        joined = joined & F.lag(c).over(w).eqNullSafe(F.col(c))
    runs = df.withColumn("_new", F.when(joined, 0).otherwise(1)).withColumn("run", F.sum("_new").over(w))
    at = F.struct(*order)
    aggs = [F.min_by("start", at).alias("start"), F.max_by("end", at).alias("end"), F.count("*").alias("n")]
    if value:
        aggs.append(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda x: x[value]), " ").alias(value))
    if mean:
        aggs.append(F.avg(mean).alias(mean))
    if weighted:
        length = F.col("end") - F.col("start")
        total = F.sum(length)
        aggs.append((F.sum(F.col(weighted) * length) / F.when(total == 0, 1.0).otherwise(total)).alias(weighted))
    if parts:
        aggs.append(F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*parts).alias("w")))), lambda x: x["w"]).alias("words"))
    return runs.groupBy(*key, *same, "run").agg(*aggs)


def speaker_totals(segments: DataFrame, key: str = "call_id") -> DataFrame:
    """(key, speaker_id, total_speech, n_segments, n_words, rank) of aligned segments; a null speaker is one speaker, ranks go by first appearance."""
    words = F.size("words") if "words" in segments.columns else F.lit(0)
    n = F.when(words > 0, words).otherwise(F.size(F.regexp_extract_all("text", F.lit(r"(?U)(\S+)"), F.lit(1))))
    g = segments.groupBy(key, "speaker_id").agg(F.round(F.sum(F.col("end") - F.col("start")), 2).alias("total_speech"), F.count("*").alias("n_segments"), F.sum(n).alias("n_words"), F.min("idx").alias("_first"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("_first"))).drop("_first")


def cluster_totals(segments: DataFrame, calls: DataFrame, key: str = "call_id", places: int | None = 4) -> DataFrame:
    """(key, cluster, speaker_id, n_segments, total_speech, speech_ratio, avg_similarity) of diarized segments; ``calls`` (key, duration).

    The speaker is that of the cluster's first segment; similarities count alike whatever their length.
    The ratio is rounded to ``places``, or whole if they are None, for those who round it by another rule.
    """
    total = F.sum(F.col("end") - F.col("start"))
    g = segments.groupBy(key, "cluster").agg(F.min_by("speaker_id", "start").alias("speaker_id"), F.count("*").alias("n_segments"), total.alias("_t"), F.round(F.avg("similarity"), 4).alias("avg_similarity"))
    share = F.col("_t") / F.col("duration")
    ratio = F.when(F.col("duration") > 0, share if places is None else F.round(share, places)).otherwise(0.0)
    return g.join(calls.select(key, "duration"), key, "left").select(key, "cluster", "speaker_id", "n_segments", F.round("_t", 2).alias("total_speech"), F.coalesce(ratio, F.lit(0.0)).alias("speech_ratio"), "avg_similarity")


def speech_islands(frames: DataFrame, key: list[str], least_speech: int, least_silence: int) -> DataFrame:
    """(key, start, end) in frames from (key, frame, speech): gaps under ``least_silence`` join, runs under ``least_speech`` go."""
    w = Window.partitionBy(*key).orderBy("frame")
    on = frames.where("speech")
    apart = F.coalesce(F.col("frame") - F.lag("frame").over(w) - 1 >= F.greatest(F.lit(1), F.lit(least_silence)), F.lit(True))
    runs = on.withColumn("run", F.sum(F.when(apart, 1).otherwise(0)).over(w)).groupBy(*key, "run").agg(F.min("frame").alias("start"), (F.max("frame") + 1).alias("end"))
    return runs.where(F.col("end") - F.col("start") >= least_speech).drop("run")


def subsegments(df: DataFrame, most: float = 1.5, least: float = 0.5) -> DataFrame:
    """Rows cut into pieces of ``most``; pieces under ``least`` go."""
    n = F.greatest(F.lit(1), F.ceil((F.col("end") - F.col("start")) / most)).cast("int")
    cut = df.withColumn("piece", F.explode(F.sequence(F.lit(0), n - 1)))
    s = F.col("start") + F.col("piece") * most
    return cut.withColumns({"end": F.least(F.col("end"), s + most), "start": s}).where(F.col("end") - F.col("start") >= least)


def frame_labels(segments: DataFrame, key: list[str], frame: float = 0.01) -> DataFrame:
    """(key, frame, label): a frame has the label of the last segment over it; starts are cut off, ends rounded up."""
    lo, hi = (F.col("start") / frame).cast("long"), F.ceil(F.col("end") / frame) - 1
    cells = segments.where(F.col("end") > F.col("start")).select(*key, "seg", "label", F.explode(F.sequence(lo, hi)).alias("frame"))
    return cells.groupBy(*key, "frame").agg(F.max_by("label", "seg").alias("label"))


def frame_errors(reference: DataFrame, hypothesis: DataFrame, key: list[str]) -> DataFrame:
    """Counts by key of reference, missed, false and confused frames; labels are compared as they are."""
    r = reference.withColumnRenamed("label", "ref")
    h = hypothesis.withColumnRenamed("label", "hyp")
    j = r.join(h, [*key, "frame"], "full")
    return j.groupBy(*key).agg(
        F.count("ref").alias("n_ref"),
        F.count_if(F.col("ref").isNotNull() & F.col("hyp").isNull()).alias("miss"),
        F.count_if(F.col("ref").isNull() & F.col("hyp").isNotNull()).alias("false_alarm"),
        F.count_if(F.col("ref") != F.col("hyp")).alias("confusion"),
    )


def purity_coverage(pairs: DataFrame, ref: str, hyp: str) -> DataFrame:
    """One row: the share of items in their cluster's main label, and in their label's main cluster.

    A null (silence) counts below the line of the other side, never as a main label.
    """
    n = pairs.groupBy(ref, hyp).agg(F.count("*").alias("n"))

    def by(c, other):
        top = n.where(F.col(c).isNotNull()).groupBy(c).agg(F.coalesce(F.max(F.when(F.col(other).isNotNull(), F.col("n"))), F.lit(0)).alias("m"), F.sum("n").alias("t"))
        return top.agg(F.sum("m").alias("m"), F.sum("t").alias("t"))

    p, c = by(hyp, ref).select((F.col("m") / F.col("t")).alias("purity")), by(ref, hyp).select((F.col("m") / F.col("t")).alias("coverage"))
    return p.crossJoin(c)  # one row each
