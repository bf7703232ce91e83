"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

A text is cut into words at blanks and into overlapping windows of ``WINDOW`` words,
``STRIDE`` apart, so that every word stands in two of them and any phrase of up to 25 words whole in
one; all windows of the whole text are scored and a text takes its highest window. A word enters as a
word embedding (words known from training) beside the mean of the embeddings of its character
trigrams, so unseen spellings still carry a signal. Training runs in numpy on the driver over a
bounded sample of labelled rows: whole-text labels teach the window of each text that scores
highest at the time (multiple-instance learning). Word embeddings start from the words' log-odds
(``preset``); without that start the network learns as well, a little more slowly (held-out accuracy
on the 0.1 table 0.975 against 0.978).

Defined cases: a null or blank text has no window and scores the bias of the output unit; null
labels and null ids are not learnt from; of labels that share an id the highest counts, and of texts
that share a labelled id the one with the smallest hash; a table without labels gives every text 0.0;
repeated rows each give a row; a very long text is scored whole, 1024 windows at once; carried columns
may have any name but those of the results; an empty table gives no rows.
"""

from __future__ import annotations

import math
import string
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, hash_order, held_out, one_text, small_batches, words_of

WINDOW, STRIDE = 48, 24
HIDDEN, WORD_DIM, CHAR_DIM, CHAR_BUCKETS = 8, 4, 4, 1 << 13
#: Bounds of the training sample: texts of each class, and characters of a text.
SAMPLE_PER_CLASS, SAMPLE_CHARS = 1500, 20_000
EPOCHS, BATCH, RATE = 8, 128, 0.02
#: Words that a task remembers before it starts afresh.
CACHE = 120_000
_PUNCT = string.punctuation + "«»„“”‘’…–—¿¡"


def _normal(word: str) -> str:
    return word.lower().strip(_PUNCT)


def _trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of all words with marked ends, and where each word starts; no trigram reaches into the next word."""
    data = np.frombuffer(b"".join(b"\xfe" + w.encode("utf-8", "replace") + b"\xff" for w in words), np.uint8).astype(np.uint32)
    a = np.append(data, [0xFE, 0xFE]).astype(np.uint32)
    inside = (a[1:-1] != 0xFE) & (a[2:] != 0xFE)
    h = (a[:-2] * np.uint32(0x9E3779B1)) ^ (a[1:-1] * np.uint32(0x85EBCA77)) ^ (a[2:] * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    starts = (np.cumsum(inside) - inside)[data == 0xFE]
    return (h[inside] % np.uint32(CHAR_BUCKETS)).astype(np.int64), starts


def _windows(n: int) -> range:
    """Starts of the windows of n words; the last one reaches the end."""
    return range(0, max(n - (WINDOW - STRIDE), 1) if n else 0, STRIDE)


def _window_matrix(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Word ids of all windows (0 where a window passes the end), and the text of each."""
    counts = np.array([len(_windows(len(x))) for x in ids], np.int64)
    sizes = np.array([len(x) for x in ids], np.int64)
    flat = np.concatenate([*ids, np.zeros(1, np.int64)])
    base = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(ids)), counts)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = k[:, None] * STRIDE + np.arange(WINDOW)[None]
    inside = at < sizes[doc][:, None]
    return np.where(inside, flat[np.minimum(base[doc][:, None] + at, len(flat) - 1)], 0), doc


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Network:
    """Parameters and passes of the network; row 0 of every word table is the padding."""

    def __init__(self, vocabulary: dict[str, int], odds: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        normal = lambda *s, scale=0.3: rng.normal(0, scale, s).astype(np.float32)
        self.vocabulary = vocabulary
        self.p = {"E": normal(len(vocabulary) + 1, WORD_DIM, scale=0.05), "C": normal(CHAR_BUCKETS, CHAR_DIM, scale=0.1), "V": normal(2 * h, h), "v": normal(h), "o": normal(2 * h), "c": np.array([-1.0], np.float32)}
        self.p["E"][1:, 0] += odds.astype(np.float32)
        self.p["E"][0] = 0
        for side in "fb":
            self.p |= {f"W{side}": normal(d, 3 * h), f"U{side}": normal(h, 3 * h), f"b{side}": np.zeros(3 * h, np.float32)}

    def inputs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Input vectors of normalised words, with what the backward pass needs."""
        known = np.array([self.vocabulary.get(w, 0) for w in words], np.int64)
        grams, starts = _trigrams(words)
        sizes = np.diff(np.append(starts, len(grams))).astype(np.float32)
        chars = np.add.reduceat(self.p["C"][grams], starts) / sizes[:, None] if len(words) else np.zeros((0, CHAR_DIM), np.float32)
        return np.concatenate([self.p["E"][known], chars], 1), known, grams, starts

    def projected(self, x: np.ndarray, side: str) -> np.ndarray:
        return x @ self.p[f"W{side}"] + self.p[f"b{side}"]

    def run(self, table: np.ndarray, windows: np.ndarray, side: str, keep: bool = False):
        """States of one direction: steps x windows x hidden."""
        h, n = HIDDEN, len(windows)
        u, state = self.p[f"U{side}"], np.zeros((n, HIDDEN), np.float32)
        states, kept = np.zeros((WINDOW, n, h), np.float32), []
        for t in range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1):
            g, m = table[windows[:, t]], state @ u
            gates = _sigmoid(g[:, : 2 * h] + m[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            c = np.tanh(g[:, 2 * h :] + r * m[:, 2 * h :])
            if keep:
                kept.append((t, state, z, r, c, m[:, 2 * h :]))
            state = c + z * (state - c)
            states[t] = state
        return states, kept

    def pooled(self, windows: np.ndarray, forward: np.ndarray, backward: np.ndarray):
        both = np.concatenate([forward, backward], 2)
        inner = np.tanh(both @ self.p["V"])
        e = inner @ self.p["v"]
        e[windows.T == 0] = -30
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        pool = np.einsum("tn,tnh->nh", a, both)
        return pool @ self.p["o"] + self.p["c"][0], both, inner, a, pool

    @staticmethod
    def padded(table: np.ndarray) -> np.ndarray:
        """Row 0 holds the state: its update gate is shut."""
        table[0] = 0
        table[0, :HIDDEN] = 40
        return table

    def logits(self, table_f: np.ndarray, table_b: np.ndarray, windows: np.ndarray) -> np.ndarray:
        out = [self.pooled(w, self.run(table_f, w, "f")[0], self.run(table_b, w, "b")[0])[0] for w in (windows[i : i + 1024] for i in range(0, len(windows), 1024))]
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def gradients(self, words: list[str], windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Mean log-loss gradients over windows; words[i] has the id i + 1."""
        h, n = HIDDEN, len(windows)
        x, known, grams, starts = self.inputs(words)
        x = np.concatenate([np.zeros((1, x.shape[1]), np.float32), x])
        tables = {s: self.padded(self.projected(x, s)) for s in "fb"}
        runs = {s: self.run(tables[s], windows, s, keep=True) for s in "fb"}
        logit, both, inner, a, pool = self.pooled(windows, runs["f"][0], runs["b"][0])
        d = ((_sigmoid(logit) - labels) / n).astype(np.float32)
        grad = {"o": pool.T @ d, "c": np.array([d.sum()], np.float32)}
        d_pool = d[:, None] * self.p["o"]
        d_a = np.einsum("tnh,nh->tn", both, d_pool)
        d_e = a * (d_a - (a * d_a).sum(0))
        d_both = a[:, :, None] * d_pool[None]
        grad["v"] = np.einsum("tn,tnh->h", d_e, inner)
        d_inner = d_e[:, :, None] * self.p["v"] * (1 - inner**2)
        grad["V"] = np.einsum("tni,tnj->ij", both, d_inner)
        d_both += d_inner @ self.p["V"].T
        d_x = np.zeros_like(x)
        for i, s in enumerate("fb"):
            u, d_table, d_u = self.p[f"U{s}"], np.zeros_like(tables[s]), np.zeros_like(self.p[f"U{s}"])
            d_state = np.zeros((n, h), np.float32)
            for t, before, z, r, c, mc in reversed(runs[s][1]):
                d_state = d_state + d_both[t][:, i * h : (i + 1) * h]
                d_c = d_state * (1 - z) * (1 - c**2)
                d_g = np.concatenate([d_state * (before - c) * z * (1 - z), d_c * mc * r * (1 - r), d_c], 1)
                d_m = np.concatenate([d_g[:, : 2 * h], d_c * r], 1)
                d_u += before.T @ d_m
                np.add.at(d_table, windows[:, t], d_g)
                d_state = d_state * z + d_m @ u.T
            d_table[0] = 0
            grad |= {f"W{s}": x.T @ d_table, f"b{s}": d_table.sum(0), f"U{s}": d_u}
            d_x += d_table @ self.p[f"W{s}"].T
        grad["E"] = np.zeros_like(self.p["E"])
        np.add.at(grad["E"], known, d_x[1:, :WORD_DIM])
        grad["E"][0] = 0
        sizes = np.diff(np.append(starts, len(grams)))
        grad["C"] = np.zeros_like(self.p["C"])
        np.add.at(grad["C"], grams, np.repeat(d_x[1:, WORD_DIM:] / sizes[:, None], sizes, axis=0))
        return grad


def train(texts: list[str], labels: list[int], seed: int = 7, preset: bool = True) -> Network | None:
    """Fits a network to labelled texts; None without both classes."""
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    split = [[w for w in map(_normal, words_of(t)) if w] or ["-"] for t in texts]
    seen = [Counter(), Counter()]
    for words, label in zip(split, labels, strict=True):
        seen[int(label)].update(set(words))
    total = [max(1, int((y == k).sum())) for k in (0, 1)]
    vocabulary, odds = {}, []
    for w in sorted(w for w in set(seen[0]) | set(seen[1]) if seen[0][w] + seen[1][w] >= 5):
        vocabulary[w] = len(vocabulary) + 1
        odds.append(math.log((seen[1][w] + 1) / (total[1] + 2)) - math.log((seen[0][w] + 1) / (total[0] + 2)))
    odds = np.array(odds) / 4 * preset
    net = Network(vocabulary, odds, seed)
    rank = {w: i + 1 for i, w in enumerate(sorted({w for words in split for w in words}))}
    words = list(rank)
    windows, doc = _window_matrix([np.array([rank[w] for w in ws], np.int64) for ws in split])
    prior = np.concatenate([[0.0], [odds[vocabulary[w] - 1] if w in vocabulary else 0.0 for w in words]])
    score = prior[windows].max(1) if preset else rng.random(len(windows))
    first, m, v, step = np.searchsorted(doc, np.arange(len(y))), {}, {}, 0
    ends = np.append(first[1:], len(doc))
    for epoch in range(EPOCHS):
        if epoch:
            x = np.concatenate([np.zeros((1, WORD_DIM + CHAR_DIM), np.float32), net.inputs(words)[0]])
            score = net.logits(net.padded(net.projected(x, "f")), net.padded(net.projected(x, "b")), windows)
        best = np.lexsort((-score, doc))[first]
        other = first + (rng.random(len(y)) * (ends - first)).astype(np.int64)
        pick = np.concatenate([best, other[y == 0]])
        target = np.concatenate([y, np.zeros(int((y == 0).sum()), np.float32)])
        order = rng.permutation(len(pick))
        for i in range(0, len(order), BATCH):
            k = order[i : i + BATCH]
            used, inverse = np.unique(windows[pick[k]], return_inverse=True)
            inverse = inverse.reshape(len(k), WINDOW)
            if used[0] != 0:
                used, inverse = np.append(0, used), inverse + 1
            grad = net.gradients([words[j - 1] for j in used[1:]], inverse, target[k])
            step += 1
            for name, g in grad.items():
                m[name] = 0.9 * m.get(name, 0) + 0.1 * g
                v[name] = 0.99 * v.get(name, 0) + 0.01 * g * g
                net.p[name] -= (RATE * (0.5 if epoch > EPOCHS // 2 else 1) * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


class Scorer:
    """Scores texts with a trained network; remembers the projected inputs of words it has met."""

    def __init__(self, net: Network):
        self.net = net
        self.forget()

    def forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.tables = [self.net.padded(np.zeros((1 << 14, 3 * HIDDEN), np.float32)) for _ in "fb"]

    def learn(self, words: list[str], first: int) -> None:
        """Fills the rows from first on; tables double, so that growth copies little."""
        x = self.net.inputs([_normal(w) or "-" for w in words])[0]
        while first + len(words) > len(self.tables[0]):
            self.tables = [np.concatenate([t, np.zeros_like(t)]) for t in self.tables]
        for table, side in zip(self.tables, "fb", strict=True):
            table[first : first + len(words)] = self.net.projected(x, side)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if len(self.ids) > CACHE:
            self.forget()
        ids, split = self.ids, [words_of(t) for t in texts]
        new = list(set().union(*split).difference(ids))
        if new:
            self.learn(new, len(ids) + 1)
            ids.update(zip(new, range(len(ids) + 1, len(ids) + 1 + len(new)), strict=True))
        get = ids.__getitem__
        windows, doc = _window_matrix([np.fromiter(map(get, w), np.int64, len(w)) for w in split])
        best = np.full(len(texts), -np.inf, np.float32)
        np.maximum.at(best, doc, self.net.logits(*self.tables, windows))
        best[np.isinf(best)] = self.net.p["c"][0]
        return _sigmoid(best.astype(np.float64))


def training_sample(documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """At most per_class labelled texts of each class, in the order of hashed ids, none held out."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = documents.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= chars)).select("doc_id")
    both = known.join(texts.distinct(), "doc_id", "left_semi")
    chosen = both.where("toxic = 1").orderBy(hash_order("doc_id"), "doc_id").limit(per_class).unionByName(both.where("toxic = 0").orderBy(hash_order("doc_id"), "doc_id").limit(per_class))
    return one_text(documents.where(F.length("text") <= chars), chosen)


def fitted(documents: DataFrame, labels: DataFrame) -> Network | None:
    rows = sorted(training_sample(documents, labels).collect(), key=lambda r: r["doc_id"])
    return train([r["text"] for r in rows], [r["toxic"] for r in rows])


def scored(documents: DataFrame, net: Network | None, carry: list[str] | None = None) -> DataFrame:
    """The carried columns of documents with score (0 to 1) and predicted (1 from 0.5 on)."""
    carry = ["doc_id"] if carry is None else carry
    if net is None:
        return documents.select(*carry).withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0))
    small_batches(documents.sparkSession)
    source = documents.select(*carry, F.col("text").alias("__text"))
    schema = documents.select(*carry).schema.add("score", "double").add("predicted", "integer")
    broadcast = documents.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        score = Scorer(broadcast.value)
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            out = [score(texts[i:j]) for i, j in chunks(texts, [len(t or "") for t in texts], 400_000)]
            s = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], [*carry, "score", "predicted"])

    return source.mapInArrow(run, schema)
