"""Quality by a regularised quadratic discriminant over document statistics.

Each text gives STATISTICS: logarithms of counts and square roots of shares, rounded to 1 / STEP, so that their sums and the
sums of their products are whole multiples and come out alike in every order of adding (up to 2^53). These sums, by label and
fold, are all that the model needs of the labelled rows; Spark adds them up over all of them, there is no sample.

Each class has its mean and a covariance that is shrunk twice, towards the covariance within both classes and then towards a
multiple of the identity. The amounts come from a grid (SHRINK): every fold is scored by models of the other folds, the
scores' histograms are calibrated, and the pair with the least log loss is taken. The factors of Cholesky are computed once
for a model and kept, inverted; a score is the difference of the classes' log-densities, which are squared lengths of a
product with them, brought to a probability by the calibration of the scores out of fold.

The label, language, source and id are never inputs of a score; rows whose crc32(doc_id) leaves 0 when divided by 5 are held
out of all learning.

Defined results: null and empty texts have the statistics of an empty text, and a score like any other; texts of any length
are counted whole; of several labels of one document the lowest counts, null labels count for nothing; with labels of one
kind only the score is that label, without labels 0.5. Repeated rows, and rows with a null doc_id, each give their row. Other
columns are left out, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import ROWS_AT_ONCE, frugal, materialize, share_order

STATISTICS = (
    "log_words", "log_word_length", "spread_of_word_length", "symbols", "exclamations", "upper", "digits", "punctuation",
    "distinct_words", "repeated_neighbours", "repeated_lines", "log_line_length", "beyond_ascii", "compressed", "short_words", "bars",
)
STEP, FOLDS, THRESHOLD = 4096, 5, 0.3
#: Shares of the covariance within both classes, and of the identity.
SHRINK = [(a, b) for a in (0.0, 0.1, 0.3, 0.6) for b in (0.001, 0.01, 0.1)]
#: Scores out of fold are counted in bins of this width, from -REACH to REACH.
WIDTH, REACH = 0.1, 40.0
_SYMBOLS, _MARKS = list(b"#*$%&|<>"), list(b".,;:?")


def statistics(raw: bytes) -> list[float]:
    """The transformed statistics of one text, given as UTF-8."""
    words = raw.split()  # of bytes: at space, tab, line feed, vertical tab, form feed and carriage return
    n, counts = len(words), np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lengths = np.fromiter(map(len, words), np.int64, n) if n else np.zeros(1, np.int64)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    inside, letters, n_words, n_lines = max(int(lengths.sum()), 1), counts[65:91].sum() + counts[97:123].sum(), max(n, 1), max(len(lines), 1)
    shares = {
        "symbols": counts[_SYMBOLS].sum() / inside,
        "exclamations": counts[33] / inside,
        "upper": counts[65:91].sum() / max(letters, 1),
        "digits": counts[48:58].sum() / inside,
        "punctuation": counts[_MARKS].sum() / inside,
        "distinct_words": len(set(words)) / n_words,
        "repeated_neighbours": sum(map(bytes.__eq__, words, words[1:])) / n_words,
        "repeated_lines": 1 - len(set(lines)) / n_lines if lines else 0.0,
        "beyond_ascii": counts[128:].sum() / inside,
        "compressed": min(len(zlib.compress(raw, 1)) / max(len(raw), 1), 1.0),
        "short_words": np.count_nonzero(lengths <= 3) / n_words if n else 0.0,
        "bars": counts[124] / inside,
    }
    logs = {"log_words": math.log1p(n), "log_word_length": math.log1p(lengths.mean()), "spread_of_word_length": math.log1p(lengths.std()), "log_line_length": math.log1p(len(raw) / n_lines)}
    return [round((logs[s] if s in logs else math.sqrt(shares[s])) * STEP) / STEP for s in STATISTICS]


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and stats of every row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(begin, ROWS_AT_ONCE)
                texts = pc.fill_null(part.column("text").cast(pa.binary()), b"")
                stats = [statistics(x.as_py()) for x in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(stats, pa.list_(pa.float64()))], ["doc_id", "stats"])

    return rows.mapInArrow(frugal(run), "doc_id long, stats array<double>")


def held_out():
    """True for the rows that nothing is learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled(feats: DataFrame, labels: DataFrame) -> DataFrame:
    """stats, good (0 or 1) and fold of every row that the model learns from."""
    labels = labels.where("doc_id is not null and quality is not null").where(~held_out())
    labels = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") > 0).cast("int").alias("good"))
    fold = F.floor(share_order("doc_id") * FOLDS).cast("int")
    return feats.join(labels, "doc_id").select("stats", "good", fold.alias("fold"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(size, len(STATISTICS))


def sums(rows: DataFrame) -> np.ndarray:
    """Products of (1, stats) with themselves, added up by fold and label: an array of FOLDS x 2 matrices."""
    d = len(STATISTICS) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, 2, d, d))
        for batch in batches:
            x = np.column_stack([np.ones(batch.num_rows), _matrix(batch.column("stats"), batch.num_rows)])
            fold, good = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fold", "good"))
            for f in range(FOLDS):
                for g in (0, 1):
                    own = x[(fold == f) & (good == g)]
                    total[f, g] += own.T @ own
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total.ravel()[at], pa.float64())], ["at", "x"])

    out = np.zeros(FOLDS * 2 * d * d)
    for r in rows.mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():  # FOLDS x 2 x d x d at most
        out[r["at"]] = r["x"]
    return out.reshape(FOLDS, 2, d, d)


class Discriminant:
    """Two Gaussians with shrunk covariances; keeps the inverted Cholesky factor of each."""

    def __init__(self, total: np.ndarray, to_pooled: float, to_identity: float):
        """total: for each class the sums of products of (1, stats)."""
        n = total[:, 0, 0]
        self.means = total[:, 0, 1:] / n[:, None]
        scatter = total[:, 1:, 1:] - n[:, None, None] * self.means[:, :, None] * self.means[:, None, :]
        pooled = scatter.sum(axis=0) / n.sum()
        self.scale = np.sqrt(np.maximum(np.diag(pooled), 1 / STEP**2))  # statistics count in units of their spread
        units = self.scale[:, None] * self.scale[None]
        self.factors, self.offsets = [], []
        for k in (0, 1):
            shrunk = (1 - to_pooled) * scatter[k] / n[k] / units + to_pooled * pooled / units
            level = max(np.trace(shrunk) / len(shrunk), 1e-6)
            shrunk = (1 - to_identity) * shrunk + to_identity * level * np.eye(len(shrunk))
            factor = np.linalg.cholesky(shrunk)
            self.factors.append(np.linalg.inv(factor))
            self.offsets.append(math.log(n[k] / n.sum()) - float(np.log(np.diag(factor)).sum()))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The log-odds of class 1, uncalibrated."""
        logs = [o - 0.5 * (((x - m) / self.scale @ f.T) ** 2).sum(axis=1) for m, f, o in zip(self.means, self.factors, self.offsets, strict=True)]
        return logs[1] - logs[0]


def bins(scores: np.ndarray) -> np.ndarray:
    return np.floor((np.clip(scores, -REACH, REACH) + REACH) / WIDTH).astype(np.int64)


def scores_out_of_fold(rows: DataFrame, total: np.ndarray) -> np.ndarray:
    """Histograms of the scores of each pair of SHRINK, by label; a row's models are those without its fold."""
    rest = total.sum(axis=0) - total
    n_bins = int(2 * REACH / WIDTH) + 1
    models = {f: [Discriminant(rest[f], *s) for s in SHRINK] for f in range(FOLDS) if rest[f, :, 0, 0].min() > 0}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((len(SHRINK), 2, n_bins), np.int64)
        for batch in batches:
            x = _matrix(batch.column("stats"), batch.num_rows)
            fold, good = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fold", "good"))
            for f, own in models.items():
                here = fold == f
                for i, model in enumerate(own):
                    np.add.at(out[i], (good[here], bins(model.scores(x[here]))), 1)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(out.ravel()[at])], ["at", "n"])

    out = np.zeros(len(SHRINK) * 2 * n_bins, np.int64)
    counted = rows.mapInArrow(run, StructType([StructField("at", LongType()), StructField("n", LongType())])).groupBy("at").agg(F.sum("n").alias("n"))
    for r in counted.collect():  # pairs of SHRINK x 2 x bins at most
        out[r["at"]] = r["n"]
    return out.reshape(len(SHRINK), 2, n_bins)


def calibration(histogram: np.ndarray) -> tuple[float, float, float]:
    """Slope and offset that turn scores into log-odds, and the log loss, from a histogram of scores by label."""
    z = -REACH + WIDTH * (np.arange(histogram.shape[1]) + 0.5)
    bad, good = histogram.astype(float)
    aims, n = np.array([1 / (bad.sum() + 2), (good.sum() + 1) / (good.sum() + 2)]), bad + good

    def loss(a: float, b: float) -> float:
        t = a * z + b
        return float((n * np.logaddexp(0, t) - (bad * aims[0] + good * aims[1]) * t).sum())

    a, b = 0.5, 0.0
    for _ in range(100):  # Newton's steps, halved until the loss falls
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
        r, w = n * p - bad * aims[0] - good * aims[1], n * np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(w * z * z).sum(), (w * z).sum()], [(w * z).sum(), w.sum()]]) + 1e-6 * np.eye(2)
        da, db = np.linalg.solve(h, [(r * z).sum(), r.sum()])
        step, now = 1.0, loss(a, b)
        while step > 1e-6 and loss(a - step * da, b - step * db) > now:
            step /= 2
        if step <= 1e-6 or abs(step * da) + abs(step * db) < 1e-9:
            break
        a, b = a - step * float(da), b - step * float(db)
    return a, b, loss(a, b)


def train(feats: DataFrame, labels: DataFrame) -> tuple | float:
    """Discriminant, slope and offset; or the one score that all rows get where there aren't labels of both kinds."""
    rows = labelled(feats, labels)
    total = sums(rows)
    n = total[:, :, 0, 0].sum(axis=0)
    if n.min() == 0:
        return 0.5 if n.max() == 0 else float(n[1] > 0)
    out_of_fold = scores_out_of_fold(rows, total)
    fits = [calibration(h) for h in out_of_fold]
    best = min(range(len(SHRINK)), key=lambda i: (fits[i][2], i))
    seen = out_of_fold[best].sum(axis=1).min() > 0
    return Discriminant(total.sum(axis=0), *SHRINK[best]), *(fits[best][:2] if seen else (1.0, 0.0))


def score(feats: DataFrame, model: tuple | float) -> DataFrame:
    """doc_id, held_out, score and predicted of every row that has stats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if isinstance(model, float):
                p = np.full(batch.num_rows, model)
            else:
                discriminant, a, b = model
                z = discriminant.scores(_matrix(batch.column("stats"), batch.num_rows))
                p = np.round(1 / (1 + np.exp(-np.clip(a * z + b, -50, 50))), 9)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    return feats.mapInArrow(frugal(run), "doc_id long, score double, predicted int").select("doc_id", held_out().alias("held_out"), "score", "predicted")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The score of every row of docs by a model of the labelled ones; texts are read once, into a work table of statistics."""
    feats = materialize(with_statistics(docs), "statistics")
    return score(feats, train(feats, labels))
