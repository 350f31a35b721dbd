import pytest
from pyspark.sql import functions as F

from colloq.functions import spans
from colloq.functions import text as tx
from colloq.operators import kernels


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("f", "given", "wanted"),
    [
        (tx.remove_diacritics, "الْعَرَبِيَّةُ", "العربية"), (tx.remove_diacritics, "الـعـربـية", "العربية"), (tx.normalize_alef, "أحمد إيمان آمال", "احمد ايمان امال"),
        (tx.normalize_yaa, "على سئل", "علي سيل"), (tx.to_ascii_digits, "الساعة ٩:٣٠", "الساعة 9:30"), (tx.light_stem, "والكتاب", "كتاب"), (tx.clean_text, "  a \n b ", "a b"),
        (tx.normalize_person, "الدكتور أحمد", "احمد"), (tx.normalize_location, "الرياض", "رياض"),
    ],
)
def test_text(spark, f, given, wanted):
    assert one(spark, f(F.lit(given))) == wanted


def test_is_arabic_and_times(spark):
    assert one(spark, tx.is_arabic(F.lit("هذا نص عربي مع word واحدة"))) is True
    assert one(spark, tx.is_arabic(F.lit("123"))) is False
    assert one(spark, tx.srt_time(F.lit(0.5))) == "00:00:00,500"
    assert one(spark, tx.srt_time(F.lit(59.9996))) == "00:01:00,000"
    assert one(spark, tx.node_id(F.lit("Person"), F.lit("احمد محمد!"))) == "Person:احمد_محمد"


def test_spans(spark):
    rows = one(spark, spans.find_all(F.lit("ab 12 é3 456"), "[0-9]+"))
    assert [(r["start"], r["end"], r["text"]) for r in rows] == [(3, 5, "12"), (7, 8, "3"), (9, 12, "456")]
    assert [(r["start"], r["sentence"]) for r in one(spark, spans.sentences(F.lit("One. Two!\nThree")))] == [(0, "One"), (5, "Two"), (10, "Three")]
    assert one(spark, spans.find_all(F.lit(""), "x")) == []


@pytest.mark.parametrize(
    ("ref", "hyp", "counts"),
    [("السلام عليكم", "السلام عليكم ورحمة الله", (2, 0, 0, 2)), ("السلام عليكم ورحمة الله", "السلام عليكم", (2, 0, 2, 0)), ("السلام عليكم", "السلام جميعاً", (1, 1, 0, 0)), ("", "a b c", (3, 0, 0, 3))],
)
def test_edits(ref, hyp, counts):
    assert kernels.edit_counts(ref.split(), hyp.split()) == counts


def test_tokens_have_their_places(spark):
    texts = [(1, "ab, cd ab"), (2, " x"), (2, "é yy"), (3, None)]
    got = sorted((r["k"], r["pos"], r["start"], r["end"], r["token"]) for r in spans.tokens(spark.createDataFrame(texts, "k int, text string"), "text", spans.TOKEN, "k").collect())
    assert got == [(1, 0, 0, 2, "ab"), (1, 1, 4, 6, "cd"), (1, 2, 7, 9, "ab"), (2, 0, 0, 1, "é"), (2, 0, 1, 2, "x"), (2, 1, 2, 4, "yy")]
