"""Toxicity by a convolutional text classifier, trained in numpy.

Words (runs of letters, lower-cased) are hashed to rows of an embedding table, and so are their first four and five
letters; a word's vector is the sum of the three. Filters of several widths run over the
word sequence, each keeps its maximum, and a logistic layer gives the score. Adam trains it on a bounded sample of
labelled texts: at most about MAX_POSITIVE toxic and MAX_NEGATIVE other documents, picked by a hash of the doc_id. One
coordinate of the embedding starts from the word's log-odds among the sample's labels; all coordinates are then trained.
A part of the sample calibrates the logit (Platt scaling) and a threshold for each language.

The label, language, source and id are never inputs of a score; the language only chooses which threshold the extra
column `flagged` uses, and null or unknown languages use the common one.

Defined results: texts without words (null, empty) get the score of an empty sequence, whose maxima are zero; without
labels of both kinds every score is 0. Repeated rows each give their row.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_batches, share_order

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 8, 4, (1, 2, 3)
MAX_POSITIVE, MAX_NEGATIVE, CALIBRATE = 1600, 2400, 0.2
EPOCHS, BATCH, RATE, SEED = 4, 64, 0.01, 7
THRESHOLD = 0.3
#: Words whose sums a task keeps, at most; that only saves time.
MAX_WORDS = 200_000
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _LETTERS.findall((text or "").lower())


def buckets(word: str) -> tuple[int, int, int]:
    """The rows of a word, of its first four and of its first five letters."""
    return tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in (word, f"4:{word[:4]}", f"5:{word[:5]}"))


class Network:
    def __init__(self, rng: np.random.Generator):
        self.embed = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
        self.filters = [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in self.filters:
            f[:, 0, 0] = 1.0 / len(f)
        self.out = np.full(len(WIDTHS) * FILTERS, 0.1, np.float32)
        self.bias = np.float32(0)

    def tables(self, rows: np.ndarray) -> list[np.ndarray]:
        """What each word, given by its rows of the embedding, adds to each filter at each of its places."""
        vectors = self.embed[rows].sum(axis=1)
        return [np.stack([vectors @ f[k] for k in range(len(f))]) for f in self.filters]

    def pooled(self, ids: np.ndarray, tables: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Maxima of all filters over the sequence, zero at least, and where they are (-1: nowhere above zero)."""
        best, where = [], []
        for t in tables:
            w = len(t)
            if len(ids) < w:
                best.append(np.zeros(FILTERS, np.float32))
                where.append(np.full(FILTERS, -1))
                continue
            c = t[0][ids[: len(ids) - w + 1]]
            for k in range(1, w):
                c = c + t[k][ids[k : len(ids) - w + 1 + k]]
            at = c.argmax(axis=0)
            top = c[at, np.arange(FILTERS)]
            best.append(np.maximum(top, 0))
            where.append(np.where(top > 0, at, -1))
        return np.concatenate(best), where

    def logit(self, ids: np.ndarray, tables: list[np.ndarray]) -> float:
        return float(self.pooled(ids, tables)[0] @ self.out + self.bias)


def _adam(value, grad, state, step, rate):
    state[0] += 0.1 * (grad - state[0])
    state[1] += 0.001 * (grad * grad - state[1])
    value -= rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-8)


def fit_network(rows: list[np.ndarray], words: np.ndarray, labels: np.ndarray) -> Network:
    """rows: each text as numbers of words; words: the embedding rows of each word."""
    rng = np.random.default_rng(SEED)
    net = Network(rng)
    counts = np.zeros((2, BUCKETS))
    for ids, y in zip(rows, labels, strict=True):
        counts[int(y), np.unique(words[ids])] += 1
    rate = (counts + 0.5) / (np.bincount(labels, minlength=2)[:, None] + 1.0)
    net.embed[:, 0] = np.log(rate[1] / rate[0]) * (1 - 1 / (1 + counts.sum(axis=0)))
    params = [*net.filters, net.out, np.zeros(1, np.float32)]
    states = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    slow = [np.zeros_like(net.embed), np.zeros_like(net.embed)]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for begin in range(0, len(order), BATCH):
            step += 1
            grads, touched, pulls = [np.zeros_like(p) for p in params], [], []
            part = order[begin : begin + BATCH]
            flat = np.unique(np.concatenate([rows[i] for i in part] or [np.zeros(0, np.int64)]))
            tables, vectors = net.tables(words[flat]), net.embed[words[flat]].sum(axis=1)
            for i in part:
                ids = rows[i]
                near = np.searchsorted(flat, ids)
                top, where = net.pooled(near, tables)
                error = 1 / (1 + np.exp(-np.clip(top @ net.out + params[-1][0], -30, 30))) - labels[i]
                grads[-2] += error * top
                grads[-1] += error
                for j, (f, at) in enumerate(zip(net.filters, where, strict=True)):
                    for c in np.flatnonzero(at >= 0):
                        g = error * net.out[j * FILTERS + c]
                        window = slice(at[c], at[c] + len(f))
                        grads[j][:, :, c] += g * vectors[near[window]]
                        touched.append(words[ids[window]].ravel())
                        pulls.append(np.repeat(g * f[:, :, c], 3, axis=0))
            for p, g, s in zip(params, grads, states, strict=True):
                _adam(p, g / len(part), s, step, RATE)
            if touched:
                ids, back = np.unique(np.concatenate(touched), return_inverse=True)
                g = np.zeros((len(ids), DIM), np.float32)
                np.add.at(g, back, np.concatenate(pulls).astype(np.float32) / len(part))
                v, s = net.embed[ids], [slow[0][ids], slow[1][ids]]
                _adam(v, g, s, step, RATE)
                net.embed[ids], slow[0][ids], slow[1][ids] = v, s[0], s[1]
    net.bias = params[-1][0]
    return net


def _platt(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of the regularised likelihood
        p = 1 / (1 + np.exp(-np.clip(a * logits + b, -30, 30)))
        r, w = weights * (p - labels), weights * np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(w * logits**2).sum() + 0.1, (w * logits).sum()], [(w * logits).sum(), w.sum() + 0.1]])
        da, db = np.linalg.solve(h, [(r * logits).sum() + 0.1 * (a - 1), r.sum() + 0.1 * b])
        a, b = a - float(np.clip(da, -1, 1)), b - float(np.clip(db, -1, 1))
    return a, b


def train(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE) -> dict | None:
    """The network, its scaling and the thresholds by language, or None without labels of both kinds."""
    labels = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None
    share = F.when(F.col("toxic"), F.lit(max_positive / sizes[True])).otherwise(F.lit(max_negative / sizes[False]))
    picked = labels.where(share_order("doc_id") < share)  # about max_positive + max_negative rows, whatever the input
    rows = docs.select("doc_id", "text", "lang").join(F.broadcast(picked), "doc_id").select("text", "lang", "toxic", share_order("doc_id", "text").alias("at")).orderBy("at").collect()
    index: dict[str, int] = {}
    ids = [np.array([index.setdefault(w, len(index)) for w in words_of(r["text"])], np.int64) for r in rows]
    words = np.array([buckets(w) for w in index], np.int64).reshape(-1, 3)
    y = np.array([int(r["toxic"]) for r in rows])
    tests = np.arange(len(rows)) % int(1 / CALIBRATE) == 0
    if len(set(y[~tests])) < 2:
        return None
    net = fit_network([x for x, t in zip(ids, tests, strict=True) if not t], words, y[~tests])
    tables = net.tables(words)
    logits, truth = np.array([net.logit(x, tables) for x, t in zip(ids, tests, strict=True) if t]), y[tests]
    kept = min(1.0, max_negative / sizes[False]) / min(1.0, max_positive / sizes[True])
    a, b = _platt(logits, truth, np.where(truth == 1, kept, 1.0)) if len(set(truth)) == 2 else (1.0, 0.0)
    scores = 1 / (1 + np.exp(-np.clip(a * logits + b, -30, 30)))
    langs = np.array([r["lang"] or "" for r in rows])[tests]
    limits = {"": THRESHOLD}
    for lang in sorted(set(langs)):
        s, t = scores[langs == lang], truth[langs == lang]
        if 0 < t.sum() < len(t):
            cuts = np.arange(1, 100) / 100
            f1 = np.array([2 * (t[s >= c]).sum() / max((s >= c).sum() + t.sum(), 1) for c in cuts])
            best = cuts[f1 == f1.max()]
            limits[lang] = float(best[len(best) // 2])
    return {"embed": net.embed, "filters": net.filters, "out": net.out, "bias": float(net.bias), "scale": (a, b), "limits": limits}


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, held_out, score, predicted, and flagged by the language's threshold, of every row of docs."""
    schema = "doc_id long, score double, predicted int, flagged boolean"

    def make():
        net = Network.__new__(Network)
        known: dict[str, int] = {}
        if model:
            net.embed, net.filters, net.out, net.bias = model["embed"], model["filters"], model["out"], model["bias"]
        tables = [np.zeros((w, 0, FILTERS), np.float32) for w in WIDTHS]

        def logits(texts: list) -> list[float]:
            nonlocal tables
            rows = [words_of(t) for t in texts]
            if len(known) > MAX_WORDS:
                known.clear()
                tables = [t[:, :0] for t in tables]
            if fresh := sorted(set().union(*rows).difference(known)):
                known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
                more = net.tables(np.array([buckets(w) for w in fresh], np.int64))
                tables = [np.concatenate(x, axis=1) for x in zip(tables, more, strict=True)]
            return [net.logit(np.fromiter(map(known.__getitem__, words), np.int64, len(words)), tables) for words in rows]

        def step(batch: dict) -> dict:
            texts = batch["text"]
            if not model:
                scores = np.zeros(len(texts))
            else:
                a, b = model["scale"]
                z = np.array([x for begin in range(0, len(texts), 500) for x in logits(texts[begin : begin + 500])])
                scores = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            limits = model["limits"] if model else {"": THRESHOLD}
            flags = [bool(s >= limits.get(k or "", THRESHOLD)) for s, k in zip(scores, batch["lang"], strict=True)]
            return {"doc_id": batch["doc_id"], "score": scores.tolist(), "predicted": (scores >= THRESHOLD).astype(int).tolist(), "flagged": flags}

        return step

    return map_batches(docs.select("doc_id", "text", "lang"), make, schema).withColumn("held_out", held_out())
