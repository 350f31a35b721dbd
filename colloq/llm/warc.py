"""WARC archives compressed by record with Zstandard, written and read back.

An archive is a run of Zstandard frames, as the public ``.warc.zst`` layout
has it: a leading skippable frame holds the dictionary, then each record is
one frame. Archives are written by Spark's own committer (a row per frame, so
a lost executor's part is written anew) to any store that Spark can write. The
line end after each row is the one byte of a skippable frame that the row ends
with, so the file stays a valid run of frames.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, lean, scratch_path, text_batches

DICTIONARY_MAGIC, SKIP_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0x184D2A50, 0xFD2FB528
#: Ends a row: a skippable frame of one byte, which is the line end.
_LINE = struct.pack("<II", SKIP_MAGIC, 1)
#: Payload bytes in an archive, about; bytes of the dictionary and of the records it is trained on.
ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLE_BYTES = 8 << 20, 16 << 10, 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """A response record, or a revisit of ``refers_to`` that holds the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _uri(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", "".join(f"%{ord(c):02X}" if c in "\r\n\0" else c for c in url)))
    if refers_to is not None:
        head += [("WARC-Refers-To", _uri(refers_to)), ("WARC-Profile", PROFILE)]
    head += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


#: What a record must have, and the digests that are checked; others are passed on unchecked.
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
DIGESTS = ("sha1", "sha256", "sha512", "md5")


def _fields(lines: list[str]) -> list[tuple[str, str]]:
    """Header fields in order, names in lower case; a line that begins with white space goes on with the one before."""
    out: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and out:
            out[-1] = out[-1][0], f"{out[-1][1]} {line.strip()}"
            continue
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"header line {line[:80]!r}")
        out.append((name.strip().lower(), value.strip()))
    return out


def _matches(stated: str, content: bytes) -> bool:
    """Whether a digest (algorithm:value, base32 or hexadecimal) is that of the content; unknown algorithms are not judged."""
    name, _, value = stated.partition(":")
    name = name.lower().replace("-", "")
    if name not in DIGESTS:
        return True
    own = hashlib.new(name, content).digest()
    return value.lower() == own.hex() or value.upper().rstrip("=") == base64.b32encode(own).decode().rstrip("=")


def _unchunked(body: bytes) -> bytes | None:
    """The content of a chunked HTTP body; None if it is not one."""
    at, out = 0, []
    while True:
        end = body.find(b"\r\n", at)
        try:
            n = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            n = -1
        if n < 0 or (n and body[end + 2 + n : end + 4 + n] != b"\r\n"):
            return None
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def parse(raw: bytes) -> dict:
    """A record of any type and version; ValueError if its header, its length or a digest is wrong.

    Field names are taken in any case, repeated fields are all kept in
    ``fields``. HTTP requests, responses and revisits have their payload apart
    (chunks are joined); other records' payload is their block. A revisit's
    payload size and digest are those that it states.
    """
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not version.startswith("WARC/"):
        raise ValueError("no WARC header")
    fields = _fields(lines)
    h: dict[str, str] = {}
    for k, v in fields:
        h.setdefault(k, v)
    for k in REQUIRED:
        if k not in h:
            raise ValueError(f"no {k}")
    if not h["content-length"].isdigit():
        raise ValueError(f"Content-Length is {h['content-length']!r}")
    n = int(h["content-length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length is {n}; the record has {len(rest) - 4}")
    if "warc-block-digest" in h and not _matches(h["warc-block-digest"], block):
        raise ValueError("the block's digest is wrong")
    kind, payload, size = h["warc-type"].lower(), block, len(block)
    if kind in ("response", "revisit", "request") and h.get("content-type", "").lower().startswith("application/http"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        own = dict(_fields(http.decode("utf-8", "replace").split("\r\n")[1:])) if gap else {}
        plain = _unchunked(payload) if "chunked" in own.get("transfer-encoding", "").lower() else None
        stated = own.get("content-length", "")
        whole = "warc-truncated" not in h
        if kind == "response" and whole and plain is None and stated.isdigit() and int(stated) != len(payload):
            raise ValueError(f"the payload has {len(payload)} of {stated} bytes")
        if kind == "response" and whole and "warc-payload-digest" in h and not any(_matches(h["warc-payload-digest"], x) for x in (payload, plain) if x is not None):
            raise ValueError("the payload's digest is wrong")
        payload = payload if plain is None else plain
        size = int(stated) if kind == "revisit" and stated.isdigit() else len(payload)
    return {
        "record_type": kind, "record_id": h["warc-record-id"], "date": h["warc-date"], "url": h.get("warc-target-uri"), "content_type": h.get("content-type"),
        "payload_bytes": size, "payload_digest": h.get("warc-payload-digest"), "refers_to": h.get("warc-refers-to"), "version": version[5:], "fields": fields, "payload": payload,
    }


def frame_size(data: memoryview, at: int) -> int:
    """Bytes of the Zstandard frame at ``at``, from its header and its blocks' headers (RFC 8878)."""
    flags = data[at + 4]
    single = flags >> 5 & 1
    n = 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
    while True:
        block = int.from_bytes(data[at + n : at + n + 3], "little")
        n += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            break
    n += 4 * (flags >> 2 & 1)
    if at + n > len(data):
        raise ValueError("the archive ends within a frame")
    return n


def frames(data: bytes):
    """Yields (place, bytes) of each record.

    The dictionary comes from the leading skippable frame, itself plain or
    compressed; an archive without one is read without a dictionary. Other
    skippable frames are passed over.
    """
    import zstandard

    view, at, reader = memoryview(data), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        magic, size = struct.unpack_from("<II", view, at) if at + 8 <= len(view) else (0, 0)
        if magic & 0xFFFFFFF0 == SKIP_MAGIC:
            if at + 8 + size > len(view):
                raise ValueError("the archive ends within a frame")
            own = bytes(view[8 : 8 + size]) if at == 0 and magic == DICTIONARY_MAGIC else b""
            if own[:4] == struct.pack("<I", FRAME_MAGIC):
                own = reader.decompress(own)
            if own:
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(own))
            at += 8 + size
        elif magic == FRAME_MAGIC:
            n = frame_size(view, at)
            yield at, reader.decompressobj().decompress(view[at : at + n])
            at += n
        else:
            raise ValueError(f"no frame at byte {at}")


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary trained on records, or none if they are too few."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def _write(batches):
    import zstandard

    held, size, writer = [], 0, None

    def ready():
        own = dictionary(held)
        return own, zstandard.ZstdCompressor(level=3, write_checksum=True, **({"dict_data": zstandard.ZstdCompressionDict(own)} if own else {}))

    def rows(values):
        return pa.record_batch([pa.array([v + _LINE for v in values], pa.binary())], ["value"])

    for batch in batches:
        out = []
        for page_id, url, payload, refers in zip(*(c.to_pylist() for c in batch.columns)):
            raw = record(page_id, url, payload, refers)
            if writer is None:
                held.append(raw)
                size += len(raw)
                if size >= SAMPLE_BYTES:
                    own, writer = ready()
                    out += [struct.pack("<II", DICTIONARY_MAGIC, len(own)) + own, *map(writer.compress, held)]
            else:
                out.append(writer.compress(raw))
        yield rows(out)
    if writer is None and held:
        own, writer = ready()
        yield rows([struct.pack("<II", DICTIONARY_MAGIC, len(own)) + own, *map(writer.compress, held)])


def write_archives(pages: DataFrame, path: str, least_revisit: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes a record for every row of ``pages`` (page_id, url, html) into archives below ``path``.

    Of equal payloads of at least ``least_revisit`` bytes the rows with the
    smallest page_id are responses and the others revisit that page. A null
    html is an empty payload; a row without page_id is a response; rows that
    repeat a page_id with one payload are all of one kind.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("payload", 256)))
    long_enough = rows.where(F.length("payload") >= least_revisit).select("page_id", "sha")
    first = durable(long_enough.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first"))
    again = durable(long_enough.join(first, "sha").where("page_id != first").select("page_id", "sha", "first").distinct())
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    n = max(1, -(-int(total) // archive_bytes))
    keys = ["page_id", "sha"]
    placed = rows.repartition(n, *keys).join(again.repartition(n, *keys), keys, "left")
    records = text_batches(placed).sortWithinPartitions("page_id", "sha").select("page_id", "url", "payload", "first").mapInArrow(lean(_write), "value binary")
    records.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\n").option("compression", "none").text(path)


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """A row for each record of the archives below ``path``, of any type; a damaged archive fails the job.

    Columns: path, place (of the frame), record_type, record_id, date, url,
    content_type, payload_bytes, payload_digest (as stated, with its
    algorithm), refers_to, version, and payload if asked for. One task reads
    one archive, whose bytes it holds; a record at a time is unpacked.
    """
    kinds = {"record_type": pa.string(), "record_id": pa.string(), "date": pa.string(), "url": pa.string(), "content_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.string(), "version": pa.string()}
    kinds |= {"payload": pa.binary()} if payload else {}

    def batch(name: str, rows: list[tuple[int, dict]]) -> pa.RecordBatch:
        own = [pa.array([r[c] for _, r in rows], k) for c, k in kinds.items()]
        return pa.record_batch([pa.array([name] * len(rows), pa.string()), pa.array([at for at, _ in rows], pa.int64()), *own], ["path", "place", *kinds])

    def run(batches):
        for archive in batches:
            for name, content in zip(archive.column(0).to_pylist(), archive.column(1)):
                held, size = [], 0
                for at, raw in frames(content.as_buffer().to_pybytes()):
                    held.append((at, parse(raw)))
                    size += len(raw)
                    if size >= SAMPLE_BYTES:
                        yield batch(name, held)
                        held, size = [], 0
                yield batch(name, held)

    names = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary"}
    schema = "path string, place long, " + ", ".join(f"{c} {names[k]}" for c, k in kinds.items())
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(lean(run), schema)


def page_of(uri: Column) -> Column:
    """The page of a record id that :func:`write_archives` has made, else null."""
    return F.regexp_extract(uri, r"^<urn:x-page:(-?\d+)>$", 1).try_cast("long")


def archived(pages: DataFrame, least_revisit: int = 0) -> DataFrame:
    """Writes ``pages`` into archives in the shared folder and reads them back: page_id, url, payload_bytes, payload_digest (bare), record_type, refers_to.

    No rows, no records.
    """
    spark = pages.sparkSession
    path = scratch_path(spark)
    write_archives(pages, path, least_revisit)
    bare = F.substring_index("payload_digest", ":", -1).alias("payload_digest")
    return read_archives(spark, path).select(page_of(F.col("record_id")).alias("page_id"), "url", "payload_bytes", bare, "record_type", page_of(F.col("refers_to")).alias("refers_to"))


def op7_warc(spark, sf_dir: str) -> DataFrame:
    return archived(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
