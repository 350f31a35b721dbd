"""Signals as rows of samples or frames: level, quality, voice activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import decibels
from . import strategies
from .intervals import speech_islands


def frames(signals: DataFrame, key: str, size: int) -> DataFrame:
    """(key, frame, rms, peak) of whole frames from rows (key, samples array); a cut-off tail is dropped."""
    n = F.floor(F.size("samples") / size).cast("int")
    whole = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(F.col("samples"), i * size + 1, F.lit(size)))
    cut = signals.select(key, F.posexplode(F.when(F.size("samples") >= size, whole)).alias("frame", "x"))  # not as a filter, which would make the samples twice
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    return cut.select(key, "frame", F.sqrt(total / size).alias("rms"), F.array_max(F.transform("x", lambda v: F.abs(v))).alias("peak"))


def frame_levels(frame_rows: DataFrame) -> DataFrame:
    return frame_rows.withColumn("db", decibels(F.col("rms")))


def _fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c with one rounding: the error of the product (Veltkamp and Dekker) and that of the sum are added last."""
    halves = lambda x: (x * 134217729.0 - (x * 134217729.0 - x), x - (x * 134217729.0 - (x * 134217729.0 - x)))
    (ah, al), (bh, bl), p = halves(a), halves(b), a * b
    lost = ((ah * bh - p) + ah * bl + al * bh) + al * bl
    s = p + c
    back = s - p
    return s + (lost + ((p - (s - back)) + (c - back)))


def quantile(ordered: Column, q: float) -> Column:
    """The continuous quantile of a sorted array, between two neighbours as DuckDB's quantile_cont has it, to the last bit: their mean by distance with a fused product."""
    at = (F.size(ordered) - 1) * F.lit(q)
    place = F.struct(ordered[F.floor(at).cast("int")].cast("double").alias("lo"), ordered[F.ceil(at).cast("int")].cast("double").alias("hi"), (at - F.floor(at)).alias("t"))
    mixed = F.transform(F.array(place), lambda x: F.when(x["t"] == 0, x["lo"]).otherwise(_fused(x["lo"], 1 - x["t"], x["hi"] * x["t"])))[0]
    return F.when(F.size(ordered) > 0, mixed)


def _threshold(ordered: Column, least_range: float, fixed: float, margin: float) -> Column:
    both = F.struct(quantile(ordered, 0.25).alias("low"), quantile(ordered, 0.95).alias("high"))
    return F.transform(F.array(both), lambda x: F.when(x["high"] - x["low"] < least_range, fixed).otherwise(F.least(x["low"] + margin, F.lit(fixed))))[0]


def voice_thresholds(levels: DataFrame, key: str, least_range: float = 10.0, fixed: float = -35.0, margin: float = 6.0) -> DataFrame:
    """(key, threshold): the quarter level and a margin, at most ``fixed``; ``fixed`` itself for flat signals. The levels of a key are gathered."""
    g = levels.groupBy(key).agg(F.array_sort(F.collect_list("db")).alias("_o"))
    return g.select(key, _threshold(F.col("_o"), least_range, fixed, margin).alias("threshold"))


def quality(signals: DataFrame, key: str, rate: int = 16_000, frame_ms: int = 30, silence_db: float = -40.0) -> DataFrame:
    """One row per signal: rms, rms_db, silence_ratio, snr_db, clipping_ratio, dynamic_range_db, issues, passes."""
    f = frame_levels(frames(signals, key, rate * frame_ms // 1000))
    quiet, speech = F.col("db") < silence_db, F.col("db") >= silence_db
    g = f.groupBy(key).agg(
        F.count("*").alias("n"), F.count_if(quiet).alias("quiet"), F.avg(F.when(speech, F.col("rms"))).alias("s"), F.avg(F.when(quiet, F.col("rms"))).alias("z"),
        F.percentile("rms", F.lit(0.10)).alias("p10"), F.percentile("rms", F.lit(0.75)).alias("p75"), F.percentile("db", F.lit(0.05)).alias("d5"), F.percentile("db", F.lit(0.95)).alias("d95"),
    )
    ratio = lambda a, b: 20 * F.log10(a / b)
    flat = F.when((F.col("p10") < 1e-10) | (F.col("p75") <= F.col("p10")), 60.0).otherwise(ratio(F.col("p75"), F.col("p10")))
    snr = F.when(F.coalesce(F.col("n") < 2, F.lit(True)) | F.col("s").isNull(), 0.0).when(F.col("z").isNull(), flat).when(F.col("z") < 1e-10, 60.0).otherwise(ratio(F.col("s"), F.col("z")))
    size = F.greatest(F.size("samples"), F.lit(1))
    power = F.aggregate("samples", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    own = signals.select(key, F.sqrt(power / size).alias("rms"), (F.size(F.filter("samples", lambda v: F.abs(v) >= 0.99)) / size).alias("clipping_ratio"))
    out = own.join(g, key, "left").select(key, "rms", decibels(F.col("rms")).alias("rms_db"), F.coalesce(F.col("quiet") / F.col("n"), F.lit(1.0)).alias("silence_ratio"), snr.alias("snr_db"), "clipping_ratio", F.coalesce(F.col("d95") - F.col("d5"), F.lit(0.0)).alias("dynamic_range_db"))
    return with_issues(out)


def with_issues(metrics: DataFrame, rules: list[tuple[str, Column]] | None = None) -> DataFrame:
    """Adds issues, the names of the rules that hold, and passes."""
    rules = rules or [("quiet", F.col("rms") < 0.001), ("noisy", F.col("snr_db") < 10), ("silent", F.col("silence_ratio") > 0.5), ("clipped", F.col("clipping_ratio") > 0.01)]
    found = F.array_compact(F.array(*[F.when(bad, name) for name, bad in rules]))
    return metrics.withColumn("issues", found).withColumn("passes", F.size("issues") == 0)


def report_status(error: Column, issues: Column, speech_ratio: Column) -> Column:
    return F.when(error.isNotNull(), "failed").when((F.size(issues) > 0) | (speech_ratio < 0.1), "warning").otherwise("ok")


def speech_only(signals: DataFrame, segments: DataFrame, key: str, rate: int = 16_000) -> DataFrame:
    """The samples inside each signal's segments, one after another."""
    s = segments.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("segs"))
    piece = lambda x: F.slice(F.col("samples"), (x["start"] * rate).cast("int") + 1, F.greatest(F.lit(0), ((x["end"] - x["start"]) * rate).cast("int")))
    return signals.join(s, key).select(key, F.flatten(F.transform("segs", piece)).alias("samples"))


def energy_segments(signals: DataFrame, key: str, rate: int = 16_000, frame_ms: int = 30, threshold: float = -35.0, least_speech_ms: int = 250, least_silence_ms: int = 200, adaptive: bool = True) -> DataFrame:
    """(key, seg, start, end) in seconds of the speech in signals (key, samples), by the level of frames.

    The threshold is that of :func:`voice_thresholds`, or ``threshold`` itself.
    Pauses under ``least_silence_ms`` do not part speech, speech under
    ``least_speech_ms`` is none. A signal shorter than a frame has no speech.
    """
    size = rate * frame_ms // 1000
    levels = frame_levels(frames(signals, key, size)).select(key, "frame", "db")
    if adaptive:  # a signal's levels are gathered once and meet their threshold there, without a join
        g = levels.groupBy(key).agg(F.collect_list(F.struct("frame", "db")).alias("_l"))
        g = g.withColumn("threshold", _threshold(F.array_sort(F.transform("_l", lambda x: x["db"])), 10.0, threshold, 6.0))
        levels = g.select(key, "threshold", F.inline("_l"))
    else:
        levels = levels.withColumn("threshold", F.lit(threshold))
    on = levels.select(key, F.col("frame").cast("long").alias("frame"), (F.col("db") >= F.col("threshold")).alias("speech"))
    runs = speech_islands(on, [key], max(1, least_speech_ms // frame_ms), max(1, least_silence_ms // frame_ms))
    seconds = size / rate
    order = F.row_number().over(Window.partitionBy(key).orderBy("start")) - 1
    return runs.select(key, (F.col("start") * seconds).alias("start"), (F.col("end") * seconds).alias("end")).withColumn("seg", order)


strategies.register("vad", "energy", energy_segments)


def speech_segments(signals: DataFrame, key: str, method: str = "energy", **options) -> DataFrame:
    """The speech that the named detector finds; a detector whose model is missing gives way to the energy rule."""
    return strategies.get("vad", method)(signals, key, **options)


def total_speech(segments: DataFrame, key: str) -> DataFrame:
    return segments.groupBy(key).agg(F.round(F.sum(F.col("end") - F.col("start")), 3).alias("total_speech"), F.count("*").alias("n_segments"))


def reports(signals: DataFrame, key: str, rate: int = 16_000, method: str = "energy") -> DataFrame:
    """One row per signal (key, samples, error or not): duration, its quality, speech, speech_ratio, status, warnings."""
    fine = signals.where("error is null") if "error" in signals.columns else signals
    q, speech = quality(fine, key, rate), total_speech(speech_segments(fine, key, method, rate=rate), key)
    error = F.col("error") if "error" in signals.columns else F.lit(None).cast("string")
    out = signals.select(key, error.alias("error"), (F.greatest(F.size("samples"), F.lit(0)) / rate).alias("duration")).join(q, key, "left").join(speech, key, "left").fillna(0, ["total_speech", "n_segments"])
    out = out.withColumn("speech_ratio", F.when(F.col("duration") > 0, F.round(F.col("total_speech") / F.col("duration"), 4)).otherwise(0.0))
    more = F.when(F.col("n_segments") == 0, "no speech").when(F.col("speech_ratio") < 0.1, F.concat(F.lit("little speech ("), F.round(100 * F.col("speech_ratio")).cast("int").cast("string"), F.lit("%)")))
    warnings = F.when(F.col("error").isNull(), F.array_compact(F.concat(F.coalesce("issues", F.array().cast("array<string>")), F.array(more)))).otherwise(F.array().cast("array<string>"))
    return out.withColumn("warnings", warnings).withColumn("status", report_status(F.col("error"), F.col("warnings"), F.col("speech_ratio")))


def embedded(signals: DataFrame, segments: DataFrame, key: str, rate: int = 16_000, method: str = "mfcc") -> DataFrame:
    """(key, seg, start, end, embedding) of the segments (key, seg, start, end): each one's samples are cut out and embedded in Arrow batches."""
    at, n = (F.col("start") * rate).cast("int"), ((F.col("end") - F.col("start")) * rate).cast("int")
    cut = segments.select(key, "seg", "start", "end").join(signals.select(key, "samples"), key).select(key, "seg", "start", "end", F.slice("samples", at + 1, F.greatest(n, F.lit(0))).alias("samples"))
    return cut.select(key, "seg", "start", "end", strategies.get("embedding", method)(F.col("samples"), F.lit(rate)).alias("embedding"))
