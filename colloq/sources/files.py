"""Sources: JSON documents, audio files, uploads, and made signals and calls."""

from __future__ import annotations

import io
import json
import struct
import uuid
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import content_id
from ..operators import strategies

WORD = "struct<word:string,start:double,end:double,confidence:double>"
SEGMENT = f"struct<speaker_name:string,speaker:string,speaker_id:string,start:double,end:double,text:string,confidence:double,words:array<{WORD}>>"
TRANSCRIPT = f"call_id string, duration_sec double, language string, segments array<{SEGMENT}>"
CLIP = "struct<clip_id:string,source:string,audio_path:string,transcript:string,duration_sec:double,speaker_id:string,gender:string,dialect:string,split:string,sample_rate:int,language:string,license:string,ingested_at:string,extra:map<string,string>>"
MANIFEST = f"version string, created_at string, total_clips int, total_duration_sec double, clips array<{CLIP}>"
WATCHLIST = "version string, terms array<struct<term:string,note:string>>"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per clip with defaults for what is missing; a missing path fails."""
    clips = spark.read.schema(MANIFEST).json(path, multiLine=True).select(F.inline("clips"))
    default = {"gender": "unknown", "dialect": "unknown", "license": "unknown", "split": "unassigned", "language": "ar"}
    return clips.withColumnRenamed("duration_sec", "duration").fillna(default)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """(call_id, idx, speaker_name, speaker_id, start, end, text, confidence, words) from transcript files, one or a folder."""
    doc = spark.read.schema(TRANSCRIPT + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path, multiLine=True)
    s = doc.select("call_id", F.posexplode("segments").alias("idx", "s"))
    return s.select("call_id", "idx", F.coalesce("s.speaker_name", "s.speaker").alias("speaker_name"), "s.speaker_id", "s.start", "s.end", "s.text", "s.confidence", "s.words")


def _documents(spark: SparkSession, path: str, schema: str, pattern: str | None = None) -> DataFrame:
    """(file, doc, error): each file as one JSON document; the text of one that is none is its error."""
    read = spark.read.option("wholetext", True).option("recursiveFileLookup", True)
    text = (read.option("pathGlobFilter", pattern) if pattern else read).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    doc = text.withColumn("doc", F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    return doc.select("file", F.col("doc").dropFields("_corrupt").alias("doc"), F.col("doc._corrupt").alias("error"))


def damaged(spark: SparkSession, path: str) -> DataFrame:
    """(file, error) of files that are not JSON documents."""
    return _documents(spark, path, TRANSCRIPT).where("error is not null").select("file", "error")


def watchlist(spark: SparkSession, path: str) -> DataFrame:
    terms = spark.read.schema(WATCHLIST).json(path, multiLine=True).select(F.inline("terms"))
    return terms.withColumn("term", F.trim("term")).where("term <> ''").dropDuplicates(["term"])


def uploads(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(call_id, path, length, sha256) of files by their content."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return b.select(content_id(F.col("content")).alias("call_id"), "path", "length", F.sha2("content", 256).alias("sha256"))


def analyses(spark: SparkSession, path: str, schema: str, pattern: str = "*.nlp.json") -> tuple[DataFrame, DataFrame]:
    """(documents, errors): files below a folder by a pattern, with their path; a file that is no document has an error and stops nothing."""
    doc = _documents(spark, path, schema, pattern)
    return doc.where("error is null").select("file", "doc.*"), doc.where("error is not null").select("file", "error")


def config(path: str, **defaults) -> dict:
    """Settings from a JSON or YAML file over ``defaults``, read by the driver; nested settings are merged by key."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        import yaml

        own = yaml.safe_load(text) or {}
    else:
        own = json.loads(text)

    def merged(a: dict, b: dict) -> dict:
        return a | {k: merged(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}

    return merged(defaults, own)


def wav_info(raw: bytes) -> dict:
    """Rate, channels, bits, frames and seconds from the chunks' headers of a RIFF file; ValueError for anything else."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, form, size = 12, None, None
    while at + 8 <= len(raw) and size is None:
        name, n = struct.unpack_from("<4sI", raw, at)
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", raw, at + 8)
        elif name == b"data":
            size = min(n, len(raw) - at - 8)
        at += 8 + n + n % 2
    if form is None or size is None or not form[4]:
        raise ValueError("no format or no samples")
    frames = size // form[4]
    return {"sample_rate": form[2], "channels": form[1], "bits": form[5], "frames": frames, "duration": frames / form[2] if form[2] else 0.0}


def audio_info(spark: SparkSession, path: str, glob: str = "*.{wav,mp3,m4a,flac,ogg}") -> DataFrame:
    """(path, length, sample_rate, channels, bits, frames, duration, error) of audio files below a folder; only WAV headers are read, others have an error."""
    kinds = {"sample_rate": "int", "channels": "int", "bits": "int", "frames": "long", "duration": "double"}

    def run(batches):
        for pdf in batches:
            rows = []
            for p, n, raw in zip(pdf["path"], pdf["length"], pdf["content"]):
                try:
                    rows.append((p, n, *wav_info(raw).values(), None))
                except (ValueError, struct.error) as e:
                    rows.append((p, n, *[None] * 5, str(e)))
            yield pd.DataFrame(rows, columns=["path", "length", *kinds, "error"]).astype({k: "Int64" for k in list(kinds)[:4]})

    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "length", "content")
    return b.mapInPandas(run, "path string, length long, " + ", ".join(f"{k} {v}" for k, v in kinds.items()) + ", error string")


def encode_wav(x: np.ndarray, rate: int = 16_000, subtype: str = "PCM_16") -> bytes:
    """A WAV file of mono samples, cut to [-1, 1]: PCM_16, PCM_24 or FLOAT."""
    x = np.clip(np.asarray(x, np.float64), -1, 1)
    form, bits = {"PCM_16": (1, 16), "PCM_24": (1, 24), "FLOAT": (3, 32)}[subtype]
    if subtype == "FLOAT":
        data = x.astype("<f4").tobytes()
    else:
        whole = np.round(x * ((1 << (bits - 1)) - 1)).astype("<i4")
        data = whole.astype("<i2").tobytes() if bits == 16 else whole.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    block = bits // 8
    head = struct.pack("<HHIIHH", form, 1, rate, rate * block, block, bits)
    return b"RIFF" + struct.pack("<I", 36 + len(data) + len(data) % 2) + b"WAVEfmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)


def _put(folder: str, name: str, content: bytes, replace: bool) -> bool:
    """Writes a file under a name of its own and then moves it, so a task that runs again does no harm."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    target = f"{root}/{name}"
    if not replace and store.get_file_info(target).type == fs.FileType.File:
        return False
    own = f"{target}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(own) as out:
        out.write(content)
    store.move(own, target)
    return True


def save_audio(signals: DataFrame, folder: str, name: str, rate: int = 16_000, subtype: str = "PCM_16") -> int:
    """Writes a WAV file ``<name>.wav`` below ``folder`` (a URI that every worker reaches) for each signal (name, samples); returns how many."""

    def run(batches):
        for pdf in batches:
            for n, x in zip(pdf[name], pdf["samples"]):
                _put(folder, f"{n}.wav", encode_wav(x, rate, subtype), True)
            yield pd.DataFrame({"n": [len(pdf)]})

    return signals.select(F.col(name).cast("string").alias(name), "samples").mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def copy_split_files(clips: DataFrame, folder: str) -> int:
    """Copies each clip's file (audio_path, split) to ``<folder>/<split>/`` unless it is there; returns how many were copied."""
    spark = clips.sparkSession
    paths = [r["audio_path"] for r in clips.select("audio_path").distinct().limit(1).collect()]
    if not paths:
        return 0
    wanted = clips.select("split", F.element_at(F.split("audio_path", "/"), -1).alias("name"), "audio_path").distinct()
    folders = [r["f"] for r in wanted.select(F.regexp_replace("audio_path", "/[^/]*$", "").alias("f")).distinct().collect()]  # folders, not files
    files = spark.read.format("binaryFile").load(folders).select(F.regexp_replace("path", "^file:/+", "/").alias("p"), "content")
    rows = wanted.join(files, F.regexp_replace("audio_path", "^file:/+", "/") == F.col("p")).select("split", "name", "content")

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"n": [sum(_put(f"{folder}/{s}", n, c, False) for s, n, c in zip(pdf["split"], pdf["name"], pdf["content"]))]})

    return rows.mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def decode_wav(raw: bytes, rate: int = 16_000) -> tuple[np.ndarray, int]:
    """Mono samples in [-1, 1] at ``rate`` from PCM WAV, channels averaged, resampled linearly."""
    with wave.open(io.BytesIO(raw)) as w:
        own, width, channels, data = w.getframerate(), w.getsampwidth(), w.getnchannels(), w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(data, np.uint8).astype(np.float64) - 128) / 128
    elif width == 3:
        b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000) - 0x800000
        x = x / 8388608.0
    else:
        x = np.frombuffer(data, {2: "<i2", 4: "<i4"}[width]) / float(1 << (8 * width - 1))
    x = x.reshape(-1, channels).mean(1)
    if own != rate and len(x):
        n = int(round(len(x) * rate / own))
        x = np.interp(np.arange(n) * own / rate, np.arange(len(x)), x)
    return x.astype(np.float32), own


def signals(spark: SparkSession, path: str, rate: int = 16_000) -> DataFrame:
    """(path, sample_rate, samples, error) of WAV files below a folder; a file that cannot be read has an error."""

    def run(batches):
        for pdf in batches:
            rows = []
            for p, raw in zip(pdf["path"], pdf["content"]):
                try:
                    x, own = decode_wav(raw, rate)
                    rows.append((p, own, x, None))
                except (wave.Error, EOFError, KeyError, ValueError) as e:
                    rows.append((p, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "sample_rate", "samples", "error"])

    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(path).select("path", "content")
    return b.mapInPandas(run, "path string, sample_rate int, samples array<float>, error string")


def made_signals(spark: SparkSession, n: int, samples: int = 4800, rate: int = 16_000) -> DataFrame:
    """(id, samples): sines of 200 Hz and more, silent in the second half of each third signal."""
    x = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: F.when((F.col("id") % 3 == 0) & (i >= samples // 2), 0.0).otherwise(0.5 * F.sin(i * (2 * np.pi / rate) * (200 + 20 * F.col("id")))))
    return spark.range(n).select("id", x.alias("samples"))


#: Shapes of made audio.
SHAPES = ("speech", "pauses", "silence", "noise", "quiet", "clipped")


def made_audio(spark: SparkSession, samples: int = 16_000, rate: int = 16_000, seed: int = 7) -> DataFrame:
    """(id, shape, samples): one signal of each of SHAPES, from column functions alone, the same in every run."""
    at = lambda i: i / float(rate)
    tone = lambda i: (F.sin(2 * np.pi * 150 * at(i)) + 0.5 * F.sin(2 * np.pi * 300 * at(i)) + 0.25 * F.sin(2 * np.pi * 600 * at(i))) / 1.75
    speech = lambda i: 0.5 * tone(i) * (0.6 + 0.4 * F.sin(2 * np.pi * 4 * at(i)))
    noise = lambda i: (F.pmod(F.xxhash64(F.lit(seed), i), F.lit(20_001)) - 10_000) / 10_000.0
    shape = F.col("shape")

    def sample(i):
        pause = F.pmod(F.floor(at(i) * 2), F.lit(2)) == 1
        return (
            F.when(shape == "speech", speech(i)).when(shape == "pauses", F.when(pause, 0.0).otherwise(speech(i))).when(shape == "silence", F.lit(0.0))
            .when(shape == "noise", 0.1 * noise(i)).when(shape == "quiet", 0.0005 * tone(i)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 4.0 * tone(i))))
        )

    rows = spark.createDataFrame(list(enumerate(SHAPES)), "id int, shape string")
    return rows.select("id", "shape", F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), sample).alias("samples"))


#: What made calls are about: two speakers take turns with these lines.
TOPICS = {
    "delivery": ("The parcel left the depot this morning.", "When will it reach the office?", "On Thursday before noon.", "Please send me the number of the driver."),
    "meeting": ("Can we meet on Sunday?", "Sunday at ten suits me.", "Then I will book the small room.", "Bring the signed pages with you."),
    "payment": ("The invoice came back unpaid.", "The bank asked for another form.", "I will send it today.", "Call me when the money arrives."),
    "travel": ("I land in Jeddah on Monday.", "Who picks you up at the airport?", "My brother is there with the car.", "See you in the evening then."),
}


def made_calls(spark: SparkSession, n: int, lines: int = 8, seed: int = 42) -> DataFrame:
    """(call_id, topic, idx, speaker_id, speaker_name, start, end, text, confidence): made calls, the same for a seed.

    Lines take 4 to 8 seconds with pauses under 1.5; all numbers come from a hash of the call and the line.
    """
    names = sorted(TOPICS)
    u = lambda salt, *c: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *c), F.lit(1_000_000)) / 1_000_000.0
    calls = spark.range(n).select(F.format_string("C-%05d", "id").alias("call_id"), F.element_at(F.array(*map(F.lit, names)), (u("topic", F.col("id")) * len(names)).cast("int") + 1).alias("topic"))
    rows = calls.withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(lines - 1))))
    said = F.create_map(*[x for k in names for x in (F.lit(k), F.array(*map(F.lit, TOPICS[k])))])[F.col("topic")]
    length, pause = F.round(4 + 4 * u("length", F.col("call_id"), F.col("idx")), 2), F.round(1.5 * u("pause", F.col("call_id"), F.col("idx")), 2)
    w = Window.partitionBy("call_id").orderBy("idx")
    end = F.sum(length + pause).over(w)
    who = F.col("idx") % 2
    return rows.select(
        "call_id", "topic", "idx", F.format_string("SPK_%02d", who + 1).alias("speaker_id"), F.element_at(F.array(F.lit("Ahmad"), F.lit("Khaled")), who + 1).alias("speaker_name"),
        F.round(end - length, 2).alias("start"), F.round(end, 2).alias("end"), F.element_at(said, F.col("idx") % 4 + 1).alias("text"), F.round(0.8 + 0.19 * u("sure", F.col("call_id"), F.col("idx")), 2).alias("confidence"),
    )


def transcribe_mock(calls: DataFrame, key: str, phrases: list[str], seconds: float = 3.0) -> DataFrame:
    """Segments of ``seconds`` over each call's duration with phrases in turn: what a speech recogniser returns, without one."""
    n = F.greatest(F.lit(1), F.ceil(F.col("duration") / seconds)).cast("int")
    s = calls.select(key, "duration", F.explode(F.sequence(F.lit(0), n - 1)).alias("idx"))
    text = F.element_at(F.array(*map(F.lit, phrases)), F.pmod("idx", F.lit(len(phrases))) + 1)
    return s.select(key, "idx", (F.col("idx") * seconds).alias("start"), F.least(F.col("duration"), (F.col("idx") + 1) * seconds).alias("end"), text.alias("text"))


def mock_words(segments: DataFrame, key: str) -> DataFrame:
    """(key, seg, idx, word, start, end, confidence): each segment's words, evenly spaced over it."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    each = segments.select(key, F.col("idx").alias("seg"), "start", "end", F.size(words).alias("n"), F.posexplode(words).alias("idx", "word"))
    step = (F.col("end") - F.col("start")) / F.col("n")
    return each.select(key, "seg", "idx", "word", (F.col("start") + F.col("idx") * step).alias("start"), (F.col("start") + (F.col("idx") + 1) * step).alias("end"), F.lit(0.9).alias("confidence"))


strategies.register("asr", "mock", transcribe_mock)


def transcribe(calls: DataFrame, key: str, backend: str = "mock", **options) -> DataFrame:
    """Segments by the named recogniser; models that are not installed are refused with the names of those that are."""
    return strategies.get("asr", backend)(calls, key, **options)
