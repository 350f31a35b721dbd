"""Archives of others, deep pages, small groups, sections against brute force, the pipeline and its stages."""

import base64
import collections
import hashlib
import random
import struct
import time

import numpy as np
import pytest
import zstandard

import corpus_pipeline
from colloq.llm import bayes_dedup, block_names, common, entropy_mix, entries, fuzzy_lines, html_blocks, robust_rules, token_spans, toxicity, warc

R = random.Random(9)
WORDS = ["".join(R.choice("abcdefghik") for _ in range(R.randint(2, 8))) for _ in range(400)]


def prose(n, r=R):
    return " ".join(r.choice(WORDS) for _ in range(n))


# Archives


def foreign(*records, dictionary=None, packed=False):
    raw = b""
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if dictionary is not None:
        own = zstandard.ZstdCompressor().compress(dictionary) if packed else dictionary
        raw += struct.pack("<II", warc.DICTIONARY_MAGIC, len(own)) + own
    write = zstandard.ZstdCompressor(**({"dict_data": data} if data else {}))
    return raw + b"".join(write.compress(x) for x in records)


def wrapped(head, block, version="1.0"):
    lines = [f"WARC/{version}", *head, f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def sha(x):
    return "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()


BODY = b"5\r\nhello\r\n6;x=y\r\n world\r\n0\r\n\r\n"
RECORDS = [
    wrapped(["WARC-Type: warcinfo", "WARC-Record-ID: <urn:uuid:1>", "WARC-Date: 2020-01-01T00:00:00Z", "Content-Type: application/warc-fields"], b"software: x\r\n"),
    wrapped(["warc-type: request", "WARC-Record-ID: <urn:uuid:2>", "WARC-Date: 2020-01-01T00:00:00Z", "WARC-Concurrent-To: <urn:uuid:3>", "WARC-Concurrent-To: <urn:uuid:4>", "Content-Type: application/http; msgtype=request"], b"GET / HTTP/1.1\r\nHost: a\r\n\r\n"),
    wrapped(["WARC-Type: response", "WARC-Record-ID: <urn:uuid:3>", "WARC-Date: 2020-01-01T00:00:00Z", "WARC-Target-URI: http://a/", f"WARC-Payload-Digest: {sha(b'hello world')}", "Content-Type: application/http;", " msgtype=response"], b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + BODY, "1.1"),
    wrapped(["WARC-Type: metadata", "WARC-Record-ID: <urn:uuid:5>", "WARC-Date: 2020-01-01T00:00:00Z", "WARC-Block-Digest: blake9:XYZ"], b""),
    wrapped(["WARC-Type: response", "WARC-Record-ID: <urn:uuid:6>", "WARC-Date: 2020-01-01T00:00:00Z", "WARC-Truncated: length", "Content-Type: application/http"], b"HTTP/1.1 200 OK\r\nContent-Length: 99\r\n\r\nabc"),
]


@pytest.mark.parametrize(("dictionary", "packed"), [(None, False), (b"", False), (b"hello world WARC/1.0 Content-Length" * 9, False), (b"hello world WARC/1.0 Content-Length" * 9, True)])
def test_foreign_archives(spark, tmp_path, dictionary, packed):
    (tmp_path / "a.warc.zst").write_bytes(foreign(*RECORDS, dictionary=dictionary, packed=packed))
    got = warc.read_archives(spark, f"file://{tmp_path}/a.warc.zst", payload=True).orderBy("place").collect()
    assert [(r["record_type"], r["payload_bytes"], r["version"]) for r in got] == [("warcinfo", 13, "1.0"), ("request", 0, "1.0"), ("response", 11, "1.1"), ("metadata", 0, "1.0"), ("response", 3, "1.0")]
    assert bytes(got[2]["payload"]) == b"hello world" and got[2]["url"] == "http://a/" and got[2]["content_type"] == "application/http; msgtype=response"
    assert [v for k, v in warc.parse(RECORDS[1])["fields"] if k == "warc-concurrent-to"] == ["<urn:uuid:3>", "<urn:uuid:4>"]


@pytest.mark.parametrize(
    "raw",
    [
        b"", b"WARC/1.0\r\n\r\n", RECORDS[0].replace(b"Content-Length: 13", b"Content-Length: 12"), RECORDS[2].replace(b"hello", b"jello"),
        wrapped(["WARC-Type: metadata", "WARC-Record-ID: <a>", "WARC-Date: x", "WARC-Block-Digest: md5:00"], b"a"), RECORDS[0].replace(b"WARC-Date: ", b"WARC-Dat: "), RECORDS[0].replace(b"Content-Length: 13", b"Content-Length: x"),
    ],
)
def test_damaged_records(raw):
    with pytest.raises(ValueError):
        warc.parse(raw)


def test_cut_archive():
    data = foreign(*RECORDS)
    with pytest.raises((ValueError, zstandard.ZstdError, IndexError)):
        list(warc.frames(data[:-4]))


# Pages


def test_deep_and_hostile_pages():
    def seconds(page):
        t = time.time()
        html_blocks.blocks(page)
        return time.time() - t

    for make in (lambda n: "<div class='a b'>x" * n, lambda n: "<iframe>x" * n, lambda n: "<video>" * n + "x", lambda n: "</p>" * n, lambda n: "<p>a<section>" * n):
        a, b = (min(seconds(make(n)) for _ in range(2)) for n in (10_000, 40_000))
        assert b < 0.5 + 12 * a, (a, b)
    found = html_blocks.blocks("<div class=x><p id=y>one</p><div class='x z'>two</div></div><p>three <math><mi>x</mi></math>")
    assert [(b.path, b.text) for b in found] == [(("div", ".x", "p", ".y"), "one"), (("div", ".x", ".z"), "two"), (("p",), "three x")]


def test_pages_of_a_table(spark):
    page = "<body><nav><a href=/>Home</a></nav><article><p>" + prose(40) + ".</p></article>"
    rows = [(1, "u", page, "k"), (1, "u", page, "k"), (2, None, None, "k"), (3, "v", "", "k"), (4, "w", "<script>x", "k"), (5, "x", "<p>" + "a b. " * 60_000, "k")]
    got = html_blocks.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == 6 and all(r["n_chars"] == len(r["text"]) for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r["page_id"]].append(r["text"])
    assert by[1][0] == by[1][1] and by[1][0].endswith(".") and "Home" not in by[1][0] and by[2] == by[3] == by[4] == [""]
    assert html_blocks.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# Quality


def judged(spark, texts, lang="en", source="s"):
    rows = [(i, t, lang, source) for i, t in enumerate(texts)]
    return {r["doc_id"]: r for r in robust_rules.rated(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}


def test_small_tables(spark):
    r = random.Random(4)
    clean = [prose(r.randint(80, 160), r) for _ in range(15)]
    junk = [prose(80, r) + " " + "#$ " * 60 for _ in range(4)]
    got = judged(spark, clean + junk)
    assert [i for i, x in got.items() if not x["kept"]] == [15, 16, 17, 18]
    assert all(x["kept"] for x in judged(spark, clean[:1]).values()) and all(x["kept"] for x in judged(spark, clean[:4]).values())
    assert all(x["n_symbols"] == (120 if i > 14 else 0) for i, x in got.items())


def test_junk_up_to_the_breakdown_point(spark):
    r = random.Random(5)
    for share in (0.03, 0.1, 0.2):
        n = int(300 * share)
        got = judged(spark, [prose(r.randint(60, 200), r) for _ in range(300 - n)] + [prose(80, r) + " " + "#$ " * 60 for _ in range(n)])
        gone = [i for i, x in got.items() if not x["kept"]]
        assert set(range(300 - n, 300)) <= set(gone) and len(gone) <= n + 24


def test_verdict_against_numpy(spark):
    """The same estimate with whole sorts and matrix algebra, over one group."""
    r = random.Random(6)
    texts = [prose(r.randint(60, 400), r) + (" # " * r.randint(1, 30) if r.random() < 0.1 else "") + ("\n" + prose(4, r)) * 2 for _ in range(250)]
    got = judged(spark, texts)
    c = [got[i] for i in range(len(texts))]
    n, chars = np.array([x["n_words"] for x in c], float), np.array([x["word_chars"] for x in c], float)
    lines = np.array([len([y for y in t.split("\n") if y.strip()]) for t in texts], float)
    angle = lambda a, b: np.arcsin(np.sqrt(np.minimum(a / np.maximum(b, 1), 1)))
    x = np.stack([np.log1p(n), np.log1p(chars / n), angle(np.array([y["n_symbols"] for y in c], float), chars), angle(np.array([y["n_dup_lines"] for y in c], float), lines), angle(np.array([y["n_repeat_words"] for y in c], float), n)], 1)
    rr = robust_rules

    def factor(mean, second):
        cov = (second - np.outer(mean, mean)) * rr.CONSISTENT
        low = np.zeros((5, 5))
        for i in range(5):
            for j in range(i + 1):
                v = max(cov[i, j], rr.FLOORS[i] ** 2) if i == j else cov[i, j]
                v -= low[i, :j] @ low[j, :j]
                low[i, j] = np.sqrt(max(v, 1e-12)) if i == j else v / low[j, j]
        return mean, low

    def distance(e):
        return (np.linalg.solve(e[1], (x - e[0]).T) ** 2).sum(0)

    def fitted(lent, steps):
        p = rr.PRIOR
        pooled = lambda rows: ((rows.sum(0) + p * lent[0]) / (len(rows) + p), (rows.T @ rows + p * lent[1]) / (len(rows) + p))
        q = np.quantile(x, [0.25, 0.5, 0.75], axis=0, method="inverted_cdf")
        scale = np.maximum((q[2] - q[0]) / 1.349, rr.FLOORS)
        low = np.concatenate([q[1][:2], q[0][2:]])
        out = []
        for e in (factor(*pooled(x)), (q[1], np.diag(scale)), (low, np.diag(scale))):
            for _ in range(steps):
                d = np.floor(np.log1p(np.minimum(distance(e), 1e6)) * rr._BINS)
                order = np.sort(d)
                earlier = np.searchsorted(order, d, "left")
                m = pooled(x[earlier < rr.SHARE * len(x)])
                e = factor(*m)
            out.append((np.log(np.diag(e[1])).sum(), e, m))
        best = min(out, key=lambda o: o[0])
        return best[1], best[2]

    q = np.quantile(x, 0.5, axis=0, method="inverted_cdf")
    lent = (q, np.outer(q, q) + np.diag(np.array(rr.SPREAD) ** 2))
    for steps in (rr.LENT_STEPS, rr.LENT_STEPS, rr.STEPS):  # all rows, the language, the source: here the same rows
        e, lent = fitted(lent, steps)
    d = distance(e)
    near = [i for i in range(len(x)) if abs(d[i] - rr.CUT) > 0.5]
    assert len(near) > 230 and all(got[i]["kept"] == (d[i] <= rr.CUT) for i in near)
    assert np.allclose([got[i]["distance"] ** 2 for i in range(len(x))], d, rtol=0.05, atol=0.05)


def test_words_of_very_long_texts(spark):
    text = ("a b c d e " * 30_000).strip()
    got = judged(spark, [text])[0]
    assert (got["n_words"], got["n_repeat_words"], got["base_failed"]) == (150_000, 150_000, True)


# Sections


def test_sections_against_brute_force(spark):
    encoding, _ = token_spans.encoder()
    texts = [prose(30) + "\n" + prose(3) + "\n\n\n" + prose(9) + " é😀ß\n", "a\n\nb", "\n\n", " x \n y ", "tail\n", None]
    got = collections.defaultdict(dict)
    for r in token_spans.section_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got[r["doc_id"]][r["section"]] = (r["start"], r["n_chars"], r["n_tokens"])
    for i, text in enumerate(texts):
        text, sections = text or "", []
        at = 0
        for line in text.splitlines(keepends=True) or [""]:
            sections.append([at, len(line), 0])
            at += len(line)
        owner = [k for k, (_, n, _) in enumerate(sections) for _ in range(n)]
        place = [k for k, ch in enumerate(text) for _ in ch.encode()]
        done = 0
        for token in encoding.encode_ordinary(text):
            n = len(encoding.decode_single_token_bytes(token))
            raw = text.encode()
            begun = [k for k in range(done, done + n) if raw[k] & 0xC0 != 0x80]
            held = [owner[place[k]] for k in begun] or [owner[place[done]]]
            best = max(sorted(set(held)), key=lambda k: (held.count(k), -k))
            sections[best][2] += 1
            done += n
        assert got[i] == {k: tuple(s) for k, s in enumerate(sections)}, text


# Toxicity and the pipeline


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents, a twelfth of them toxic, exact and near copies, nulls; and labels."""
    r = random.Random(1)
    rows, labels = [], []
    for i in range(480):
        bad = i % 12 == 0
        words = prose(r.randint(20, 120), r).split(" ")
        if bad:
            words[r.randrange(len(words))] = "zork" + r.choice(("ing", "ed", "s"))
        rows.append((i, " ".join(words), "en", f"s{i % 3}", 0, i))
        labels.append((i, 1, int(bad)))
    kept = [x for x in rows if x[0] % 12]
    rows += [(1000 + k, kept[k][1].replace(" ", "  "), "en", "s0", 0, k) for k in range(20)]
    near = max(kept[40:], key=lambda x: len(x[1]))
    rows += [(2000, near[1] + " tail", "en", "s1", 0, 0), (3000, None, None, None, 0, 0), (3001, "", "de", "s2", 0, 0), (3002, "  ", "de", "s2", 0, 0)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows, near[0]


def test_scores(spark, corpus):
    path, rows, _ = corpus
    got = {r["doc_id"]: r for r in toxicity.scored(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [i for i in range(480) if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == int(i % 12 == 0) for i in held) >= len(held) - 2 and got[3000]["score"] == got[3001]["score"] == 0
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert toxicity.scored(docs, spark.read.parquet(f"{path}/labels.parquet").limit(0)).where("score != 0").count() == 0
    assert toxicity.scored(docs.limit(0), spark.read.parquet(f"{path}/labels.parquet")).count() == 0


def test_pipeline(spark, corpus):
    path, rows, near = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    after, last = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        last = common.durable(stage(spark, last, path))
        assert last.columns == docs.columns
        after[name] = collections.Counter(r["doc_id"] for r in last.select("doc_id").collect())
    clean = {x[0] for x in rows if not (x[0] < 480 and x[0] % 12 == 0)}
    assert len(clean - set(after["toxicity"])) <= 2 and len(set(after["toxicity"]) - clean) <= 2
    one = after["exact_dedup"]
    assert sum(i in one for i in (3000, 3001, 3002)) == 1 and all(not (k in one and 1000 + k in one) for k in range(20))
    assert (near in after["minhash_near_dedup"]) != (2000 in after["minhash_near_dedup"]) and set(after["minhash_near_dedup"]) <= set(one)
    assert max(after["entropy_mixing"].values()) <= 2 and set(after["entropy_mixing"]) <= set(after["minhash_near_dedup"])
    packed = corpus_pipeline.STAGES[-1][1](spark, last, path).collect()
    assert collections.Counter(r["doc_id"] for r in packed if r["start"] == 0) == after["entropy_mixing"]
    assert sorted(n for n, _ in corpus_pipeline.STAGES) == sorted(["toxicity", "exact_dedup", "minhash_near_dedup", "entropy_mixing", "bin_packing"])
    whole = corpus_pipeline.run(spark, path)
    assert sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in whole.collect()) == sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in packed)


def test_empty_stages(spark, corpus):
    path, *_ = corpus
    none = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, path).count() == 0


def test_registry():
    assert [n for n in entries.queries() if n.startswith("op")] == ["op1_token_counts", "op2_fuzzy_lines", "op3_exact_dedup", "op4_toxicity", "op5_html_extraction", "op6_quality_rules", "op7_warc", "op8_minhash_near_dedup", "op9_bin_packing", "op10_entropy_mixing"]


# Lines


def test_frequent_band_keys(spark, monkeypatch):
    """The same components when common keys go their own way."""
    r = random.Random(2)
    base = prose(40, r)
    rows = [(i, f"{base} {i:03d}") for i in range(300)] + [(500 + i, prose(30, r)) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, fuzzy_lines.fuzzy_lines(docs).collect()))
    monkeypatch.setattr(fuzzy_lines, "SAMPLED", 1)
    assert sorted(map(tuple, fuzzy_lines.fuzzy_lines(docs).collect())) == want
    assert {x[3] for x in want if x[0] < 300} == {0}


def test_very_long_texts(spark):
    text = prose(120_000)
    docs = spark.createDataFrame([(1, text), (2, text + " x"), (3, "short")], "doc_id long, text string")
    assert {r["doc_id"]: r["kept"] for r in fuzzy_lines.fuzzy_lines(docs).collect()} == {1: True, 2: False, 3: True}
    assert {r["doc_id"]: r["kept"] for r in bayes_dedup.near_duplicates(docs).collect()} == {1: True, 2: False, 3: True}
    assert {r["doc_id"]: r["kept"] for r in block_names.exact_duplicates(docs).collect()} == {1: True, 2: True, 3: True}
    assert sum(r["size"] for r in entropy_mix.mixed(docs.selectExpr("*", "'s' as source")).collect()) == 240_002
