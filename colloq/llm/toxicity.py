"""Toxicity scores from a bidirectional gated recurrent network in numpy.

A word's input is the sum of what is known of the word (a hashed embedding)
and of its characters (the mean of hashed n-gram embeddings), so inflected and
unseen forms of a word score like their stem. Gated recurrent units read each
window of words in both directions, attention pools their states, and a
logistic output scores the window. A document's score is the highest of all
its overlapping windows, which cover the whole text.

Training is multiple-instance: a label belongs to a document, not to a window.
The first round takes the window around each toxic document's most telling
n-gram, later rounds the window that the network itself scores highest. It
uses a bounded sample of labelled rows and runs in one executor task, which
returns the weights (under 4 MB); scoring is one pass without a shuffle.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, mix, text_batches, words_of


#: Words in a window and between the starts of two windows.
SPAN, STEP = 48, 24
#: Labelled rows of each class in the training sample, and characters in one at most.
SAMPLE = {1: 1600, 0: 2400}
SAMPLE_CHARS = 60_000
WORD_ROWS, GRAM_ROWS, WORD_DIM, GRAM_DIM, UNITS = 1 << 14, 1 << 15, 8, 16, 8
#: Words whose inputs a worker remembers, and words scored at once.
CACHE, AT_ONCE = 60_000, 80_000
STEPS, BATCH = (260, 160, 80), 64


_PUNCTUATION = b".,;:!?\"'()[]{}<>#*$%&|-_/\\~`^+=@"


class Features:
    """For words in a row: each one's row in the word table, its n-grams' number and their rows."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, grams: np.ndarray):
        self.ids, self.sizes, self.grams = ids, sizes, grams
        self.starts = np.cumsum(sizes) - sizes

    def take(self, rows: np.ndarray) -> Features:
        n = self.sizes[rows]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.starts[rows], n)
        return Features(self.ids[rows], n, self.grams[at])


def features(words: list[bytes], at_once: int = 20_000) -> Features:
    """The features of words, some at a time, so that what is made on the way stays small."""
    parts = [_features(words[i : i + at_once]) for i in range(0, len(words), at_once)]
    return Features(*(np.concatenate([getattr(p, name) for p in parts]) for name in ("ids", "sizes", "grams"))) if parts else _features(words)


def _features(words: list[bytes]) -> Features:
    """Lower-cased words without punctuation; n-grams are of 3 and 4 bytes of UTF-8 with marks at both ends."""
    text = b"\n".join(words).decode("utf-8", "replace").lower().encode().translate(None, _PUNCTUATION)
    raw = np.frombuffer(b"^" + text.replace(b"\n", b"$$\n^") + b"$$\n\n\n", np.uint8)
    h, _, _ = words_of(raw, np.array([0, len(raw)]), lower=False)
    line = raw == 10
    code = raw[:-3].astype(np.uint64) << np.uint64(16) | raw[1:-2].astype(np.uint64) << np.uint64(8) | raw[2:-1].astype(np.uint64)
    codes = np.stack([code, code << np.uint64(8) | raw[3:].astype(np.uint64) | np.uint64(1 << 40)], 1)
    three = ~(line[:-3] | line[1:-2] | line[2:-1])
    valid = np.stack([three, three & ~line[3:]], 1)
    grams = (mix(codes[valid]) % np.uint64(GRAM_ROWS)).astype(np.int32)
    word = np.cumsum(line[:-3])
    sizes = np.bincount(np.repeat(word, valid.sum(1)), minlength=len(words))[: len(words)]
    return Features((h % np.uint64(WORD_ROWS)).astype(np.int32), sizes, grams)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Parameters, forward pass and gradients; float32 throughout."""

    def __init__(self, seed: int = 11):
        r, h = np.random.default_rng(seed), UNITS
        n = lambda *shape, s: (r.standard_normal(shape) * s).astype(np.float32)
        self.p = {
            "word": n(WORD_ROWS, WORD_DIM, s=0.05), "gram": n(GRAM_ROWS, GRAM_DIM, s=0.3),
            "w": n(WORD_DIM + GRAM_DIM, 6 * h, s=0.35), "b": np.zeros(6 * h, np.float32),
            "u": n(2, h, 3 * h, s=0.3), "att": n(2 * h, s=0.3), "out": n(2 * h, s=0.3), "bias": np.zeros(1, np.float32),
        }
        self.shift, self.scale = np.float32(0), np.float32(1)

    def inputs(self, f: Features) -> tuple[np.ndarray, np.ndarray]:
        """Projected inputs (words, 6 * UNITS), the first half for the forward direction, and what they project."""
        mean = np.add.reduceat(self.p["gram"][f.grams], f.starts) / f.sizes[:, None].astype(np.float32)
        x = np.concatenate([self.p["word"][f.ids], mean], 1)
        return x @ self.p["w"] + self.p["b"], x

    def forward(self, table: np.ndarray, index: np.ndarray, live: np.ndarray, keep: bool = False):
        """Logits of windows: ``index`` (windows, span) into ``table``, ``live`` marks true words."""
        h, (n, span), u = UNITS, index.shape, self.p["u"]
        state, states, trail = np.zeros((2, n, h), np.float32), np.empty((span, n, 2 * h), np.float32), []
        for t in range(span):
            a, b = t, span - 1 - t
            x = np.stack([table[index[:, a], : 3 * h], table[index[:, b], 3 * h :]])
            g = state @ u
            zr = _sigmoid(x[..., : 2 * h] + g[..., : 2 * h])
            z, r = zr[..., :h], zr[..., h:]
            new = np.tanh(x[..., 2 * h :] + r * g[..., 2 * h :])
            m = np.stack([live[:, a], live[:, b]])[..., None]
            after = np.where(m, new + z * (state - new), state)
            if keep:
                trail.append((state, z, r, new, g[..., 2 * h :], m))
            state = after
            states[a, :, :h], states[b, :, h:] = after[0], after[1]
        score = np.where(live.T, states @ self.p["att"], -1e9)
        weight = np.exp(score - score.max(0))
        weight /= weight.sum(0)
        pooled = (weight[..., None] * states).sum(0)
        logit = pooled @ self.p["out"] + self.p["bias"]
        return (logit, states, weight, pooled, trail) if keep else logit

    def gradients(self, table: np.ndarray, index: np.ndarray, live: np.ndarray, label: np.ndarray):
        h, (n, span), u = UNITS, index.shape, self.p["u"]
        logit, states, weight, pooled, trail = self.forward(table, index, live, True)
        d = ((_sigmoid(logit) - label) / n).astype(np.float32)
        g = {"out": pooled.T @ d, "bias": d.sum(keepdims=True)}
        dp = d[:, None] * self.p["out"]
        dw = (states * dp).sum(2)
        ds = weight * (dw - (weight * dw).sum(0))
        g["att"] = np.einsum("tn,tnk->k", ds, states)
        dstates = weight[..., None] * dp + ds[..., None] * self.p["att"]
        du, dtable_x = np.zeros_like(u), np.zeros((span, 2, n, 3 * h), np.float32)
        back = np.zeros((2, n, h), np.float32)
        for t in range(span - 1, -1, -1):
            a, b = t, span - 1 - t
            state, z, r, new, gn, m = trail[t]
            back = back + np.stack([dstates[a, :, :h], dstates[b, :, h:]])
            da = back * m
            dz = da * (state - new) * z * (1 - z)
            dn = da * (1 - z) * (1 - new * new)
            dr = dn * gn * r * (1 - r)
            dx = np.concatenate([dz, dr, dn], 2)
            dg = np.concatenate([dz, dr, dn * r], 2)
            du += state.transpose(0, 2, 1) @ dg
            back = back * (1 - m) + da * z + dg @ u.transpose(0, 2, 1)
            dtable_x[t] = dx
        g["u"] = du
        # By place in the window: the backward direction read from the end.
        flat = np.concatenate([dtable_x[:, 0], dtable_x[::-1, 1]], 2).transpose(1, 0, 2).reshape(n * span, 6 * h)
        order = np.argsort(index.ravel(), kind="stable")
        rows, first = np.unique(index.ravel()[order], return_index=True)
        dtable = np.zeros_like(table)
        dtable[rows] = np.add.reduceat(flat[order], first)
        return g, dtable, logit


def _rows_sum(ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(ids, kind="stable")
    rows, first = np.unique(ids[order], return_index=True)
    return rows, np.add.reduceat(values[order], first)


class _Trainer:
    def __init__(self, net: Network):
        self.net, self.t = net, 0
        self.m = {k: np.zeros_like(v) for k, v in net.p.items() if k not in ("word", "gram")}
        self.v = {k: np.zeros_like(v) for k, v in self.m.items()}
        self.sq = {k: np.full(len(net.p[k]), 1e-8, np.float32) for k in ("word", "gram")}

    def step(self, rows: Features, index, live, label, rate: float = 0.01, sparse: float = 0.08) -> None:
        net = self.net
        table, x = net.inputs(rows)
        g, dtable, _ = net.gradients(table, index, live, label)
        g["w"], g["b"] = x.T @ dtable, dtable.sum(0)
        dx = dtable @ net.p["w"].T
        self.t += 1
        for k, grad in g.items():
            self.m[k] += 0.1 * (grad - self.m[k])
            self.v[k] += 0.01 * (grad * grad - self.v[k])
            net.p[k] -= rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-7)
        spread = np.repeat(dx[:, WORD_DIM:] / rows.sizes[:, None].astype(np.float32), rows.sizes, axis=0)
        for k, (at, grad) in (("word", _rows_sum(rows.ids, dx[:, :WORD_DIM])), ("gram", _rows_sum(rows.grams, spread))):
            self.sq[k][at] += (grad * grad).mean(1)
            net.p[k][at] -= sparse * grad / np.sqrt(self.sq[k][at])[:, None]


def _windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For documents of ``counts`` words in a row: each window's first word, its words, its document."""
    many = np.where(counts > SPAN, -(-(counts - SPAN) // STEP) + 1, (counts > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(counts)), many)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    begin = (np.cumsum(counts) - counts)[doc] + nth * STEP
    return begin, np.minimum(SPAN, counts[doc] - nth * STEP), doc


def _grid(words: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(SPAN)
    live = at[None, :] < length[:, None]
    return words[np.where(live, begin[:, None] + at[None, :], begin[:, None])], live


def document_logits(net: Network, table: np.ndarray, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Highest window logit of each document (-inf without words) and that window's first word."""
    begin, length, doc = _windows(counts)
    logits = np.empty(len(begin), np.float32)
    for at in range(0, len(begin), 2048):
        s = slice(at, at + 2048)
        logits[s] = net.forward(table, *_grid(words, begin[s], length[s]))
    best, where = np.full(len(counts), -np.inf, np.float32), np.zeros(len(counts), np.int64)
    order = np.lexsort((logits, doc))
    last = np.flatnonzero(np.append(np.diff(doc[order]), 1)) if len(doc) else []
    best[doc[order][last]], where[doc[order][last]] = logits[order][last], begin[order][last]
    return best, where


def train(texts: list[str], labels: list[int], seed: int = 11) -> Network | None:
    """A network from labelled texts; None if a class is missing."""
    label = np.array(labels, np.float32)
    if not len(label) or label.min() == label.max():
        return None
    place: dict[bytes, int] = {}
    each = [np.array([place.setdefault(w, len(place)) for w in (t or "").encode().split()], np.int32) for t in texts]
    words, counts = np.concatenate(each), np.array([len(s) for s in each], np.int64)
    del each
    rows = features(list(place)) if place else None
    if rows is None:
        return None
    starts, r, net = np.cumsum(counts) - counts, np.random.default_rng(seed), Network(seed)
    # How telling each n-gram is, by the share of toxic and clean documents that hold it.
    share = np.zeros((2, GRAM_ROWS))
    for k in range(len(counts)):
        own = np.unique(words[starts[k] : starts[k] + counts[k]])
        if len(own):
            share[int(label[k]), np.unique(rows.take(own).grams)] += 1
    share = np.log((share[1] + 0.5) / (label.sum() + 1)) - np.log((share[0] + 0.5) / ((1 - label).sum() + 1))
    telling = np.add.reduceat(share[rows.grams], rows.starts) / rows.sizes
    centre = np.array([starts[k] + (np.argmax(telling[words[starts[k] : starts[k] + counts[k]]]) if counts[k] else 0) for k in range(len(counts))])
    usable = [np.flatnonzero((label == c) & (counts > 0)) for c in (0, 1)]
    if not len(usable[0]) or not len(usable[1]):
        return None
    trainer = _Trainer(net)
    for phase, steps in enumerate(STEPS):
        for _ in range(steps):
            pick = np.concatenate([r.choice(usable[0], BATCH // 2), r.choice(usable[1], BATCH // 2)])
            free = np.maximum(counts[pick] - SPAN, 0)
            near = np.clip(centre[pick] - starts[pick] - r.integers(0, SPAN, BATCH), 0, free)
            if phase:
                near = np.clip(centre[pick] - starts[pick] + r.integers(-4, 5, BATCH), 0, free)
            anywhere = (r.random(BATCH) * (free + 1)).astype(np.int64)
            # Any window of a clean document is clean; half of them are those that look worst.
            at = np.where((label[pick] == 1) | (r.random(BATCH) < 0.5), near, anywhere)
            index, live = _grid(words, starts[pick] + at, np.minimum(SPAN, counts[pick] - at))
            used, inverse = np.unique(index, return_inverse=True)
            trainer.step(rows.take(used), inverse.reshape(index.shape), live, label[pick], 0.01 / (1 + phase))
        table = _table(net, rows)
        logits, centre = document_logits(net, table, words, counts)
    # The threshold that errs least on the sample, in the middle of its gap.
    own = np.isfinite(logits)
    x, y = logits[own], label[own]
    order = np.argsort(x)
    errors = np.concatenate([[0], np.cumsum(y[order] == 1)]) + np.concatenate([np.cumsum((y[order] == 0)[::-1])[::-1], [0]])
    bounds = np.concatenate([[x.min() - 1], (x[order][1:] + x[order][:-1]) / 2, [x.max() + 1]])
    gaps = np.concatenate([[0], np.diff(x[order]), [0]])
    best = np.flatnonzero(errors == errors.min())
    net.shift = np.float32(bounds[best[np.argmax(gaps[best])]])
    return net


def _table(net: Network, rows: Features, at_once: int = 20_000) -> np.ndarray:
    return np.concatenate([net.inputs(rows.take(np.arange(i, min(i + at_once, len(rows.ids)))))[0] for i in range(0, len(rows.ids), at_once)])


class _Words(dict):
    """Rows of the input table by word; new words wait in ``fresh``."""

    def __init__(self):
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


def scorer(net: Network | None):
    """Arrow batches (doc_id, text) to (doc_id, score)."""

    def run(batches):
        place, table = _Words(), np.zeros((0, 6 * UNITS), np.float32)
        for batch in batches:
            texts, at = batch.column(1), 0
            scores = np.zeros(len(texts))
            while net is not None and at < len(texts):
                words, counts = [], []
                while at + len(counts) < len(texts) and (not counts or len(words) < AT_ONCE):
                    x = texts[at + len(counts)]
                    own = x.as_buffer().to_pybytes().split() if x.is_valid else []
                    words += own
                    counts.append(len(own))
                if len(place) > CACHE:
                    place, table = _Words(), table[:0]
                index = np.array([place[w] for w in words], np.int64)
                if place.fresh:
                    table = np.concatenate([table, _table(net, features(place.fresh))])
                    place.fresh = []
                logits, _ = document_logits(net, table, index, np.array(counts, np.int64))
                scores[at : at + len(counts)] = np.where(np.isfinite(logits), _sigmoid((logits.astype(np.float64) - net.shift).clip(-60, 60)), 0.0)
                at += len(counts)
            yield pa.record_batch([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    return run


def _remainder():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic): a bounded sample of labelled rows outside the held-out fifth, by a hash of doc_id."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(_remainder() != 0)
    picked = None
    for toxic, n in SAMPLE.items():
        part = known.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        picked = part if picked is None else picked.unionByName(part)
    # At most sum(SAMPLE.values()) rows of two numbers; of rows that repeat a doc_id one text is taken.
    own = docs.where(F.length("text") <= SAMPLE_CHARS).select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return own.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic")


def _fitted(batches):
    """The whole sample, in one task, to one row: the pickled network, or null if there is nothing to learn."""
    rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    texts, labels = [text for _, text, _ in rows], [toxic for _, _, toxic in rows]
    del rows
    net = train(texts, labels)
    yield pa.record_batch([pa.array([net and pickle.dumps(net)], pa.binary())], ["net"])


def fit(docs: DataFrame, labels: DataFrame) -> bytes | None:
    """The pickled network. Only its weights come to the driver; the bounded sample goes to one executor task."""
    rows = training_rows(docs, labels).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("toxic").cast("int"))
    found = rows.repartition(1).mapInArrow(lean(_fitted), "net binary").first()
    return found and found["net"]


def _network(pickled: bytes | None) -> Network | None:
    return pickle.loads(pickled) if pickled else None


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Null, empty and blank texts score 0. Without labelled rows of both classes
    there is nothing to learn and every score is 0. Rows that repeat a doc_id
    are scored alike if their texts are; extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))  # a few MB, whatever the input

    def run(batches):
        yield from scorer(_network(shared.value))(batches)

    out = text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, score double")
    return out.select("doc_id", F.coalesce(_remainder() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that are predicted toxic, in one pass over the texts.

    Null, empty and blank texts stay, as does every row if there are no labels
    of both classes. Repeated rows go or stay together; all columns of ``docs``
    are returned as they are. No rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    place = docs.columns.index("doc_id"), docs.columns.index("text")

    def run(batches):
        net = _network(shared.value)
        for batch in batches:
            pair = pa.record_batch([batch.column(place[0]), batch.column(place[1])], ["doc_id", "text"])
            for out in scorer(net)([pair]):
                yield batch.filter(pa.array(out.column(1).to_numpy() < 0.5))

    return text_batches(docs).mapInArrow(lean(run), docs.schema)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


