"""Token counts of sections by offset-mapped attribution.

Each document is encoded once, whole. A token's characters follow from the
running sum of its tokens' bytes; sections are intervals of characters, and a
sorted interval join gives each token its section. A token that crosses a
boundary goes to the section that holds most of its characters, the earlier
one in a tie; a token that begins inside a character belongs where that
character is. Sections' counts add up to the document's tokens. One pass, no shuffle.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, text_batches


def encoder(path: str | None = None):
    """The encoding and each id's number of bytes."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    width = np.zeros(max(ranks.values()) + 1, np.int64)
    for piece, i in ranks.items():
        width[i] = len(piece)
    return tiktoken.Encoding("colloq", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), width


def token_spans(ids: np.ndarray, width: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Each token's first character and the character after its last; equal if it begins inside a character and ends there too."""
    end = np.cumsum(width[ids])
    begin = end - width[ids]
    lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    if lead.all():
        return begin, end
    chars = np.concatenate([[0], np.cumsum(lead)])
    return chars[begin], chars[end]


def attribute(first: np.ndarray, last: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, boundary-crossing tokens) of each section; sections are disjoint, sorted and cover the text."""
    inside = np.where(last > first, first, np.maximum(first - 1, 0))
    at = np.searchsorted(starts, inside, "right") - 1
    to = np.searchsorted(starts, np.maximum(last - 1, inside), "right") - 1
    crossing = np.flatnonzero(to > at)
    for t in crossing:
        some = np.arange(at[t], to[t] + 1)
        shared = np.minimum(ends[some], last[t]) - np.maximum(starts[some], first[t])
        at[t] = some[np.argmax(shared)]
    return np.bincount(at, minlength=len(starts)), np.bincount(at[crossing], minlength=len(starts))


def _lines(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lines with their line feeds, as intervals of characters; an empty text is one empty section."""
    sizes = np.array([len(x) + 1 for x in text.split("\n")], np.int64)
    sizes[-1] -= 1
    ends = np.cumsum(sizes)
    starts = ends - sizes
    if len(sizes) > 1 and not sizes[-1]:  # nothing follows the last line feed
        return starts[:-1], ends[:-1]
    return starts, ends


def section_tokens(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per section (line): doc_id, section, start, n_chars, n_tokens, n_crossing.

    A null or empty text has one section without tokens. Rows that repeat a
    doc_id are attributed each by itself. Texts are encoded whole, whatever
    their length. No rows give no rows; other columns are ignored.
    """

    def run(batches):
        encoding, width = encoder(path)
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for row, value in enumerate(batch.column(1)):
                text = value.as_py() or ""
                starts, ends = _lines(text)
                if text:
                    raw = text.encode()
                    tokens, crossing = attribute(*token_spans(encoding.encode_to_numpy(text, disallowed_special=()).astype(np.int64), width, raw), starts, ends)
                else:
                    tokens = crossing = np.zeros(1, np.int64)
                for column, x in zip(out, (np.full(len(starts), row), np.arange(len(starts)), starts, ends - starts, tokens, crossing)):
                    column.append(x)
            if out[0]:
                rows, *rest = (np.concatenate(x).astype(np.int64) for x in out)
                yield pa.record_batch([batch.column(0).take(pa.array(rows)), *map(pa.array, rest)], ["doc_id", "section", "start", "n_chars", "n_tokens", "n_crossing"])

    rows = text_batches(docs).select(F.col("doc_id").cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(lean(run), "doc_id long, section long, start long, n_chars long, n_tokens long, n_crossing long")


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    return section_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
