"""Small fixtures against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from colloq.llm import bayes_dedup, bin_packing, block_names, components, entropy_mix, fuzzy_lines, html_blocks, robust_rules, token_spans, toxicity, warc

R = random.Random(3)
WORDS = ["".join(R.choice("abcdefgh") for _ in range(R.randint(2, 7))) for _ in range(300)]
BASE = [" ".join(R.choice(WORDS) for _ in range(n)) for n in (30, 60, 200, 3000)]


def near(text, n):
    w = text.split(" ")
    for _ in range(n):
        w[R.randrange(len(w))] = R.choice(WORDS)
    return " ".join(w)


TEXTS = [*BASE, BASE[0] + " ", " ".join(BASE[1].split(" ")).replace(" ", "\t"), near(BASE[2], 3), near(BASE[2], 4), near(BASE[2], 60), near(BASE[3], 20), None, "", " \n ", "one two", "ONE two", "é ü 😀 ß", BASE[1] + "\n" + BASE[1] + "\n" + BASE[0]]
ROWS = [(i, t, ("en", "de", None)[i % 3], ("a", "b", None, "c")[i % 4], 0, "x", 1) for i, t in enumerate(TEXTS)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name string, level int"


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d.parquet")
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def words(t):
    return [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]


def closure(n, linked):
    up = list(range(n))
    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = up[a], up[b]
                up = [min(x, y) if u in (x, y) else u for u in up]
    return up


@pytest.mark.parametrize("block", [4, 4096])
def test_exact(docs, block):
    norm = [re.sub(r"[\x20\x09-\x0D]+", "", t or "") for t in TEXTS]
    best = {}
    for i in sorted(range(len(TEXTS)), key=lambda i: (-len(TEXTS[i] or ""), i)):
        best.setdefault(norm[i], i)
    size = collections.Counter(norm)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in block_names.exact_duplicates(docs, block=block).collect()}
    assert got == {i: (best[n], size[n], best[n] == i) for i, n in enumerate(norm)}
    assert block_names.drop_exact_duplicates(docs).columns == docs.columns


def test_near(docs):
    low = [[re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(t)] for t in TEXTS]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for w in low]
    up = closure(len(sets), lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]))
    for tile in (192, 2):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in bayes_dedup.near_duplicates(docs, tile=tile).collect()}
        assert got == {i: (len(s), up[i]) for i, s in enumerate(sets)}
    assert bayes_dedup.least_matches(24, 0.85) > 5


def test_lines(docs):
    lines = [(i, n, x.strip(" \t\x0b\x0c\r")) for i, t in enumerate(TEXTS) for n, x in enumerate((t or "").split("\n"))]
    sets = [{x[k : k + 5] for k in range(len(x) - 4)} if len(x) >= 5 else {x} if x else set() for _, _, x in lines]
    up = closure(len(sets), lambda a, b: bool(sets[a]) and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    got = {(r["doc_id"], r["line_no"]): (r["keep_doc_id"], r["keep_line_no"], r["kept"]) for r in fuzzy_lines.fuzzy_lines(docs).collect()}
    assert got == {(i, n): (*lines[up[k]][:2], up[k] == k) for k, (i, n, _) in enumerate(lines)}


def test_short_lines(spark):
    r, rows = random.Random(11), []
    for i in range(3000):  # pairs at Jaccard similarity n / (n + n // 4), from 0.8
        n = 4 + i % 23
        line = "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n + 2)).join("xy")
        rows += [(2 * i, line), (2 * i + 1, line + "".join(r.choice("ABCDEFGH") for _ in range(n // 4)))]
    got = {x["doc_id"]: x["keep_doc_id"] for x in fuzzy_lines.fuzzy_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = collections.Counter(4 + i % 23 for i in range(3000) if got[2 * i + 1] == 2 * i)
    assert all(got[2 * i] == 2 * i and got[2 * i + 1] in (2 * i, 2 * i + 1) for i in range(3000))
    assert sum(found.values()) >= 2970 and sum(found[n] for n in (4, 5)) >= 254, found


def test_components(spark):
    e = [(i, i + 1) for i in range(0, 30)] + [(50, 60), (60, 55), (7, 7)]
    got = dict(components.connected_components(spark.createDataFrame(e, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(31)}, 50: 50, 55: 50, 60: 50}


def test_packing(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bin_packing.vocabulary_path())
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in enumerate(TEXTS)}
    rows = bin_packing.packed(docs, window=256).collect()
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in by.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and sum(n for _, n in s) <= 256
    best = lambda c, room: max(s for s in {sum(x * k for x, k in zip(c, ks)) for ks in np.ndindex(*[v + 1 for v in c.values()])} if s <= room)
    for c, room in (({7: 2, 5: 3, 3: 1}, 20), ({9: 1, 4: 2}, 12), ({2: 5}, 7)):
        assert sum(k * v for k, v in bin_packing.fill(c, room).items()) == best(c, room)


def test_word_ids():
    from tokenizers import Tokenizer

    t, own, r = Tokenizer.from_file(bin_packing.vocabulary_path()), bin_packing._WordIds(bin_packing.vocabulary_path()), random.Random(1)
    for _ in range(5000):
        x = "".join(r.choice("abzJjTtÉé́̌ñſßΣςİ1٣!?.,;:#*$%&'\"-_(<|>€😀ﬁŉ  \n") for _ in range(r.randint(1, 12)))
        assert np.frombuffer(b"".join(own[p] for p in bin_packing.split_words(x.encode())), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def test_mixing(docs, spark):
    rows = entropy_mix.mixed(docs).collect()
    assert [r["size"] for r in sorted(rows, key=lambda r: r["doc_id"])] == [len(words(t)) for t in TEXTS]
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows) and rows and sorted(map(tuple, rows)) == sorted(map(tuple, entropy_mix.mixed(docs).collect()))
    many = spark.range(4000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id * 7 % 300 as int)) as text", "concat('s', id % 7) as source")
    total = collections.Counter()
    for r in (got := entropy_mix.mixed(many).collect()):
        total[r["target"], r["source_size"]] += r["taken"]
    assert abs(sum({(r["source_size"], r["target"]) for r in got} and [t for t, _ in total]) - 1.5 * sum(s for _, s in total)) < 1
    assert all(abs(n - t) <= 0.01 * t for (t, _), n in total.items())


def test_quality(docs):
    for r in robust_rules.rated(docs).collect():
        t = TEXTS[r["doc_id"]] or ""
        w = words(t)
        c = collections.Counter(zip(w, w[1:], w[2:]))
        cover = {k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if words(x)]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(cover), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and (not r["base_failed"] or not r["kept"])


def test_quality_outliers(spark):
    r = random.Random(7)
    some = lambda n, pool=WORDS: [r.choice(pool) for _ in range(n)]
    rows = [" ".join(some(r.randint(60, 200))) for _ in range(400)]
    lines = [w + x for w in WORDS[:40] for x in ("", "", "")][:100]
    r.shuffle(lines)
    passage = some(20)
    bad = {
        "length": " ".join(some(3000)),
        "word_length": " ".join(x + y for x, y in zip(some(100), some(100))),
        "symbols": " ".join(some(80) + ["#"] * 20),
        "dup_lines": "\n".join(lines),
        "repeats": " ".join(passage + some(60) + passage),
    }
    got = robust_rules.rated(spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate([*rows, *bad.values()])], "doc_id long, text string, lang string, source string")).collect()
    gone = {x["doc_id"] for x in got if not x["kept"]}
    assert not any(x["base_failed"] for x in got)
    assert {400, 401, 402, 403, 404} <= gone and len(gone) <= 5 + 20


def test_toxicity():
    r = random.Random(5)
    bad = [r.randrange(6) == 0 for _ in range(500)]
    texts = [" ".join([*(r.choice(WORDS) for _ in range(r.randint(5, 90))), *(["zork" + r.choice(("a", "en", "ly"))] if b else []), *(r.choice(WORDS) for _ in range(r.randint(5, 90)))]) for b in bad]
    net = toxicity.train(texts[:350], [int(b) for b in bad[:350]])
    import pyarrow as pa

    batch = pa.record_batch([pa.array(range(151)), pa.array([*texts[350:], None])], ["doc_id", "text"])
    scores = pa.Table.from_batches(list(toxicity.scorer(net)([batch]))).column("score").to_pylist()
    assert sum((s >= 0.5) == b for s, b in zip(scores, bad[350:])) >= 147 and scores[-1] == 0
    assert toxicity.train(["a"], [1]) is None


def test_pages():
    page = '<html><head><title>t</title></head><body><nav><a href="/">Home</a></nav><div class="cookie-banner">We use cookies.</div><article><h1>A &amp; b</h1><p>Some  text\nhere that is <b>long</b> enough. It goes on.<p>Next one, also a paragraph of text.</article><div class="comments"><p>I like this article very much.</p></div><footer>&copy; us</footer><script>x="<p>no</p>"</script>'
    assert html_blocks.main_texts(html_blocks.trained(), [page, "", "plain"])[:2] == ["A & b\nSome text here that is long enough. It goes on.\nNext one, also a paragraph of text.", ""]


def test_warc(spark):
    rows = [(5, "u", "<p>é"), (3, None, "<p>é"), (9, "a\nb", None), (2, "v", ""), (None, "w", "<p>é"), (7, "z", "q\n\r\n\0" * 5000)]
    got = {r["page_id"]: r for r in warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, _, h in rows:
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len((h or "").encode()), warc.digest((h or "").encode()))
    assert {i: r["refers_to"] for i, r in got.items()} == {5: 3, 3: None, 9: 2, 2: None, None: None, 7: None}
    with pytest.raises(ValueError):
        warc.parse(warc.record(1, "u", b"abc")[:-5])


def test_attribution(spark, docs):
    starts, ends = np.array([0, 4, 6]), np.array([4, 6, 10])
    tokens, crossing = token_spans.attribute(np.array([0, 3, 5, 2, 6]), np.array([3, 6, 7, 2, 10]), starts, ends)
    assert tokens.tolist() == [2, 2, 1] and crossing.tolist() == [0, 2, 0]
    encoding, _ = token_spans.encoder()
    total = collections.Counter()
    for r in token_spans.section_tokens(docs).collect():
        total[r["doc_id"]] += r["n_tokens"]
    assert total == {i: len(encoding.encode_ordinary(t or "")) for i, t in enumerate(TEXTS)} | {}


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    for f in (block_names.exact_duplicates, bayes_dedup.near_duplicates, fuzzy_lines.fuzzy_lines, bin_packing.packed, entropy_mix.mixed, robust_rules.rated, token_spans.section_tokens):
        assert f(none).count() == 0
