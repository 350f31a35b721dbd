"""Column functions for Arabic and general text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .lexicons import HONORIFICS, STEM_ARTICLES, STEM_SUFFIXES

INDIC, ASCII = "٠١٢٣٤٥٦٧٨٩", "0123456789"
PUNCTUATION = r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~،؛؟«»…]"


def remove_diacritics(c: Column) -> Column:
    return F.regexp_replace(c, "[ً-ْٰـ]", "")


def normalize_alef(c: Column) -> Column:
    return F.translate(c, "إأآٱ", "اااا")


def normalize_yaa(c: Column) -> Column:
    return F.translate(c, "ىئ", "يي")


def normalize_taa(c: Column) -> Column:
    return F.translate(c, "ة", "ه")


def to_ascii_digits(c: Column) -> Column:
    return F.translate(c, INDIC, ASCII)


def to_indic_digits(c: Column) -> Column:
    return F.translate(c, ASCII, INDIC)


def remove_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, PUNCTUATION, " ")


def collapse_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def clean_text(c: Column, nfc: bool = True) -> Column:
    """NFC, no diacritics, single spaces. Spark has no normal forms, hence the one Arrow step."""
    return collapse_whitespace(remove_diacritics(_nfc(c) if nfc else c))


def normalize_for_asr(c: Column, nfc: bool = True) -> Column:
    return collapse_whitespace(remove_punctuation(normalize_yaa(normalize_alef(remove_diacritics(_nfc(c) if nfc else c)))))


def arabic_ratio(c: Column) -> Column:
    """Arabic code points over letters; null without letters."""
    arabic = F.length(F.regexp_replace(c, "[^؀-ۿ]", ""))
    letters = F.length(F.regexp_replace(c, r"\P{L}", ""))
    return F.when(letters > 0, arabic / letters)


def is_arabic(c: Column, threshold: float = 0.5) -> Column:
    return F.coalesce(arabic_ratio(c) >= threshold, F.lit(False))


def word_count(c: Column) -> Column:
    t = collapse_whitespace(remove_diacritics(c))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def light_stem(c: Column) -> Column:
    """One article, one particle, one suffix off, each only if enough of the word is left."""
    w = normalize_yaa(normalize_alef(remove_diacritics(c)))
    cut = F.when(F.lit(False), w)
    for p in STEM_ARTICLES:
        cut = cut.when(w.startswith(p) & (F.length(w) > len(p) + 1), F.substring(w, len(p) + 1, 1 << 20))
    w = cut.otherwise(w)
    w = F.when(F.substring(w, 1, 1).isin("و", "ف", "ب", "ل") & (F.length(w) > 2), F.substring(w, 2, 1 << 20)).otherwise(w)
    cut = F.when(F.lit(False), w)
    for s in sorted(STEM_SUFFIXES, key=len, reverse=True):
        cut = cut.when(w.endswith(s) & (F.length(w) > len(s) + 2), F.substring(w, F.lit(1), F.length(w) - len(s)))
    return cut.otherwise(w)


def normalize_person(c: Column) -> Column:
    plain = collapse_whitespace(normalize_yaa(normalize_alef(remove_diacritics(c))))
    heads = sorted({h.translate(str.maketrans("إأآٱىئ", "اااايي")) for h in HONORIFICS}, key=len, reverse=True)
    pattern = "^(?:(?:" + "|".join(h.replace(".", r"\.") for h in heads) + r")[.:]*\s+)+"
    return F.regexp_replace(plain, pattern, "")


def normalize_location(c: Column) -> Column:
    plain = collapse_whitespace(normalize_yaa(normalize_alef(remove_diacritics(c))))
    return F.when(plain.startswith("ال") & (F.length(plain) > 3), F.substring(plain, 3, 1 << 20)).otherwise(plain)


def normalize_organization(c: Column) -> Column:
    return collapse_whitespace(normalize_alef(remove_diacritics(c)))


def squeezed(c: Column) -> Column:
    """Without diacritics and with one alef."""
    return normalize_alef(remove_diacritics(c))


def strip_space(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def srt_time(seconds: Column, mark: str = ",") -> Column:
    """HH:MM:SS,mmm with milliseconds rounded before they are split, so 59.9996 carries."""
    ms = F.round(seconds * 1000).cast("long")
    part = lambda unit, most: F.floor(ms / unit) % most
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(ms / 3_600_000), part(60_000, 60), part(1000, 60), ms % 1000)


def short_time(seconds: Column) -> Column:
    return F.format_string("%02d:%02d", F.floor(seconds / 60), F.floor(seconds) % 60)


def node_id(kind: Column, name: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(F.trim(name), " ", "_"), "[^؀-ۿ\\p{L}\\p{N}_]", "")
    return F.concat(kind, F.lit(":"), clean)


def entity_id(call: Column, kind: Column, start: Column, end: Column) -> Column:
    return F.concat_ws(":", call, kind, start, end)


def event_id(call: Column, sentence_start: Column, action: Column) -> Column:
    return F.concat_ws(":", call, F.lit("event"), sentence_start, action)


def content_id(content: Column) -> Column:
    return F.concat(F.lit("C-"), F.substring(F.sha2(content, 256), 1, 12))


def decibels(x: Column) -> Column:
    return 20 * F.log10(F.greatest(x, F.lit(1e-10)))


def probability(logprob: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.exp(logprob)))
