"""What the findings of round 2 asked for."""

import collections

import numpy as np

from colloq.llm import common, entropy_mix, fuzzy_lines

from .test_round2 import shuffled


def test_mixing_leaves_texts_where_they_are(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16k")
    try:
        docs = spark.range(6000).selectExpr("id AS doc_id", "concat('a', repeat(' w', cast(id % 90 AS int))) AS text", "concat('s', id % 3) AS source").repartition(3, "doc_id")
        want = {r["doc_id"]: r["copies"] for r in entropy_mix.mixed(docs).collect() if r["copies"]}
        got = entropy_mix.mix(docs)
        assert collections.Counter(r["doc_id"] for r in got.collect()) == want and {1, 2} == set(want.values()) and len(want) < 6000
        assert shuffled(got) == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_band_rows_are_dealt_once(spark, monkeypatch):
    moved = []
    monkeypatch.setattr(fuzzy_lines, "durable", lambda df: (moved.append(df) if df.columns[:2] == ["key", "lo"] else None, common.durable(df))[1])
    texts = [f"line {i * 7919} of words number {i * i}" for i in range(300)]
    texts[9] = texts[4] + "."
    rows = {r["doc_id"]: r["keep_doc_id"] for r in fuzzy_lines.fuzzy_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [{t[i : i + 5] for i in range(len(t) - 4)} for t in texts]
    links = [(a, b) for b in range(300) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = list(range(300))
    for _ in texts:
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    assert (4, 9) in links and rows[9] == want[9] and all(want[r] == want[k] for r, k in rows.items())
    assert len(moved) == 1 and shuffled(moved[0]) == 300 * fuzzy_lines.BANDS


def test_repeated_doc_ids_give_a_text_once(spark, monkeypatch):
    bodies = []

    def own(members, first, found, *rest):
        bodies.extend(found.collect())
        return banded(members, first, found, *rest)

    banded = fuzzy_lines.banded_components
    monkeypatch.setattr(fuzzy_lines, "banded_components", own)
    line = "one of the lines that many documents share"
    texts = [(1, line), (1, line), (1, line + "!"), (2, line + "?"), (3, "another line altogether, and alone"), (None, line)]
    rows = [tuple(r) for r in fuzzy_lines.fuzzy_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()]
    assert sorted((d or 9, k) for d, _, _, k, _, _ in rows) == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 3), (9, 1)]
    assert sorted(r["body"] for r in bodies) == [line, line + "!", line + "?"] and len({r["rep"] for r in bodies}) == 3


def test_sets_of_lines():
    lines = ["", "a", "abcd", "abcde", "aaaaaaaaaa", "", "one line and one line and", "xy", "\U0001f600" * 3, "z" * 200_000, "q"]
    lines += [f"{i} line {i * i} of some" for i in range(500)]
    got = fuzzy_lines._sets(lines)
    own, hashes = fuzzy_lines._hashes(lines)
    assert len(got) == len(lines)
    assert all(np.array_equal(x, np.unique(hashes[own == i])) for i, x in enumerate(got))


def test_lines_without_a_likely_partner_are_not_fetched(spark, monkeypatch):
    """In a bucket of three, the texts that only share a band key with others are not read again; links between others than the lead stay."""
    bodies = []

    def own(members, first, found, *rest):
        bodies.extend(found.collect())
        return banded(members, first, found, *rest)

    banded, signed = fuzzy_lines.banded_components, fuzzy_lines._signed

    def same_key(lines):
        size, sketch, bands = signed(lines)
        bands[:, 0] = 7
        return size, sketch, bands

    monkeypatch.setattr(fuzzy_lines, "banded_components", own)
    monkeypatch.setattr(fuzzy_lines, "_signed", same_key)
    texts = [" ".join(f"{w}{i * 7919 + k * k}" for k, w in enumerate("some words of a line that is long enough to be judged by its own signature".split())) for i in range(40)]
    texts += [texts[30] + " x", texts[35] + " y"]
    rows = {r["doc_id"]: r["keep_doc_id"] for r in fuzzy_lines.fuzzy_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert rows == {i: {40: 30, 41: 35}.get(i, i) for i in range(42)}
    assert {texts[i] for i in (30, 35, 40, 41)} <= {r["body"] for r in bodies} and len(bodies) < 20
