"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of character n-grams up to ORDER over its words, each word padded by a boundary sign on both
sides. Counts, continuation counts and context totals lie in arrays sorted by the 64-bit hash of the n-gram. A text
gets the language of the lowest cross-entropy per character. It is rejected if that cross-entropy lies beyond the
language's calibrated limit, or if it has no letters. The score is the best language's share of the likelihoods, at a
temperature fitted so that scores are right as often as they say.

Limits: calibration texts go to the language they are taken for, as labels may be wrong. Their cross-entropies have a mean
there, and a variance a + b / characters, fitted by least squares; both without the texts beyond the TRIMMED share. The
distances to the mean, in such standard deviations, have their 75th and 95th percentile; the limit is where the tail through
both, which falls exponentially, leaves BEYOND of the texts, and LEAST_LIMIT at least. Percentiles and tail are a language's
own where it has OWN_TAIL calibration texts, else those of all languages together. So no single text sets a limit.

A text with a token, a name list or a second language in it lies beyond that limit too, and is no other language. So the limit
is also at least half-way from the mean to what the models say of known negatives: calibration texts with their letters
shuffled, of which the median counts. The fewer letters a text has, the more of the way it may go (by 1 / square root).

Training takes a bounded sample: at most about MAX_TRAIN documents of each language for counts and MAX_CALIBRATE for
limits and temperature, picked by a hash of the doc_id, whole texts of up to MAX_CHARS characters. A language with fewer documents than both bounds
together learns from all of them, and is calibrated by cross-fitting: each of FOLDS parts is scored by a model of the
others. Where a language has fewer than ENOUGH calibration texts its mean and variance are at least those of the calibration texts
of all languages together; without any such text the limit is that
of a guess among the language's letters. So every language has a limit, at any size of the input. Texts are scored whole,
of any length.

Defined results: a null text, or one without letters, is `und` with score 0 and rejected; a language that is null or
empty teaches nothing; no labelled text at all: everything is `und`. Repeated rows each give their row; ties go to the
first language in alphabetical order. Columns but doc_id, text and lang have no part, whatever their names.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_batches, held_out, map_batches, share_order

ORDER = 5
MAX_TRAIN, MAX_CALIBRATE = 400, 400
FOLDS, ENOUGH = 3, 10
#: For limits: texts beyond this share are odd; a limit leaves so many of the usual texts; texts for a tail of one's own.
TRIMMED, BEYOND, OWN_TAIL = 0.95, 1e-4, 100
#: Calibration texts of each language whose letters are shuffled, at most.
SHUFFLED, SEED = 50, 5
#: Texts beyond this aren't learned from.
MAX_CHARS = 200_000
#: Temperatures that are tried, and the least limit and standard deviation of cross-entropies.
TEMPERATURES, LEAST_LIMIT, LEAST_DEVIATION = (0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0), 4.0, 0.01
UNDETERMINED = "und"
#: What Python takes for a word's character but isn't a letter: numbers such as a superscript two.
_NUMBERS = "".join(c for c in map(chr, range(0x110000)) if c.isnumeric() and not c.isdecimal() and not c.isalpha())
#: A search for all of them at once, with those beyond U+FFFF, would be many times slower.
_LETTERS, _NUMBER = re.compile(r"[^\W\d_]+"), re.compile(f"[{''.join(c for c in _NUMBERS if c <= chr(0xFFFF))}]")
_FAR, _FAR_NUMBER = re.compile("[\U00010000-\U0010ffff]"), re.compile(f"[{''.join(c for c in _NUMBERS if c > chr(0xFFFF))}]")
_BOUND = 0x110000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    low = (text or "").lower()
    if not low.isascii():
        if _NUMBER.search(low):
            low = _NUMBER.sub(" ", low)
        if _FAR.search(low):
            low = _FAR_NUMBER.sub(" ", low)
    return _LETTERS.findall(low)


def _points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words with their bounds, and where each word starts."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + ORDER
    starts = np.cumsum(sizes) - sizes
    out = np.full(int(sizes.sum()), _BOUND, np.uint64)
    inner = np.ones(len(out), bool)
    for k in range(ORDER - 1):
        inner[starts + k] = False
    inner[starts + sizes - 1] = False
    out[inner] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, starts


def _grams(points: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-gram that ends at each place from ORDER - 1 on."""
    h = np.full(len(points) - ORDER + 1, n, np.uint64)
    for k in range(n - 1, -1, -1):
        h = (h ^ points[ORDER - 1 - k : len(points) - k]) * _MIX
        h ^= h >> np.uint64(29)
    return h


def _places(points: np.ndarray, starts: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which n-gram ends count (all but the leading bounds), and their word."""
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(points))))
    ok = np.ones(len(points), bool)
    for k in range(ORDER - 1):
        ok[starts + k] = False
    return ok[ORDER - 1 :], owner[ORDER - 1 :]


class CharModel:
    """Interpolated Kneser-Ney: probabilities of a character after up to ORDER - 1 others."""

    def __init__(self, words: list[str]):
        points, starts = _points(words)
        ok, _ = _places(points, starts, None)
        self.levels = []
        full, counts = np.unique(_grams(points, ORDER)[ok], return_counts=True)
        first = np.unique(_grams(points, ORDER)[ok], return_index=True)[1]
        places = np.flatnonzero(ok)[first] + ORDER - 1  # of one occurrence of each distinct n-gram
        self.letters = len(np.unique(points)) + 1
        for n in range(ORDER, 0, -1):
            ones, twos = int((counts == 1).sum()), int((counts == 2).sum())
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            context = self._context(points, places, n)
            order = np.argsort(context, kind="stable")
            keys, at = np.unique(context[order], return_index=True)
            totals, types = np.add.reduceat(counts[order], at), np.diff(np.append(at, len(order)))
            self.levels.append((full, counts.astype(np.float64), keys, totals.astype(np.float64), types * discount, discount))
            if n > 1:  # continuation counts: in how many distinct n-grams the shorter one ends
                shorter = self._hash_at(points, places, n - 1)
                full, first, counts = np.unique(shorter, return_index=True, return_counts=True)
                places = places[first]

    @staticmethod
    def _hash_at(points, places, n):
        h = np.full(len(places), n, np.uint64)
        for k in range(n - 1, -1, -1):
            h = (h ^ points[places - k]) * _MIX
            h ^= h >> np.uint64(29)
        return h

    @classmethod
    def _context(cls, points, places, n):
        return cls._hash_at(points, places - 1, n - 1)

    def log_probabilities(self, points: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Natural logarithms of the probability of the character at each place, given those before it."""
        return Models([self]).log_probabilities(points, places)[:, 0]


def _side_by_side(tables: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Tables of sorted keys and columns as one: all keys, and for each column a matrix with a column for each table."""
    keys = np.unique(np.concatenate([t[0] for t in tables]))
    out = [np.zeros((len(keys), len(tables))) for _ in tables[0][1:]]
    for i, (own, *columns) in enumerate(tables):
        at = np.searchsorted(keys, own)
        for matrix, column in zip(out, columns, strict=True):
            matrix[at, i] = column
    return keys, *out


class Models:
    """Several models as one set of sorted arrays, so that one search finds an n-gram in all of them."""

    def __init__(self, models: list[CharModel]):
        self.letters = np.array([m.letters for m in models], np.float64)
        self.grams, self.contexts, self.discounts = [], [], []
        for level in range(ORDER if models else 0):
            parts = [m.levels[level] for m in models]
            self.grams.append(_side_by_side([(full, counts) for full, counts, *_ in parts]))
            self.contexts.append(_side_by_side([(keys, totals, backoff) for _, _, keys, totals, backoff, _ in parts]))
            self.discounts.append(np.array([x[-1] for x in parts]))

    @staticmethod
    def _look(table: tuple[np.ndarray, ...], wanted: np.ndarray) -> list[np.ndarray]:
        keys, *columns = table
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        found = (keys[at] == wanted)[:, None]
        return [np.where(found, c[at], 0.0) for c in columns]

    def log_probabilities(self, points: np.ndarray, places: np.ndarray) -> np.ndarray:
        """A row for each place, a column for each model. Equal n-grams of the highest order are looked up once."""
        _, first, back = np.unique(CharModel._hash_at(points, places, ORDER), return_index=True, return_inverse=True)
        places = places[first]
        p = np.repeat(1.0 / self.letters[None], len(places), axis=0)
        for n in range(1, len(self.contexts) + 1):
            level = ORDER - n
            total, backoff = self._look(self.contexts[level], CharModel._context(points, places, n))
            seen = np.maximum(self._look(self.grams[level], CharModel._hash_at(points, places, n))[0] - self.discounts[level], 0.0)
            safe = np.maximum(total, 1.0)
            p = np.where(total > 0, seen / safe + backoff / safe * p, p)
        return np.log(p)[back]


def _slices(sizes: list[int], most: int) -> Iterator[slice]:
    """Cuts a list into parts whose sizes sum up to `most` at most, or of one entry."""
    begin = total = 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > most:
            yield slice(begin, i)
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield slice(begin, len(sizes))


class Scorer:
    """Sums log-probabilities of texts under all languages; remembers words it has seen, up to a bound."""

    MAX_WORDS = 300_000
    #: Characters of texts, and of new words, that are worked on at once.
    TEXTS_AT_ONCE, NEW_AT_ONCE = 1_000_000, 200_000

    def __init__(self, models: dict[str, CharModel]):
        self.models = Models([models[k] for k in sorted(models)])
        self.clear()

    def clear(self):
        self.index: dict[str, int] = {}
        self.sums = np.zeros((0, len(self.models.letters) + 1))

    def add(self, rows: list[list[str]]) -> None:
        if len(self.index) > self.MAX_WORDS:
            self.clear()
        fresh = sorted(set().union(*rows).difference(self.index))
        sums = [self.sums]
        for part in _slices(list(map(len, fresh)), self.NEW_AT_ONCE):
            sums.append(self._sums_of(fresh[part]))
        self.index.update(zip(fresh, range(len(self.sums), len(self.sums) + len(fresh)), strict=True))
        self.sums = np.concatenate(sums)

    def _sums_of(self, fresh: list[str]) -> np.ndarray:
        points, starts = _points(fresh)
        ok, owner = _places(points, starts, None)
        places, owner = np.flatnonzero(ok) + ORDER - 1, owner[ok]
        sums = [np.bincount(owner, x, len(fresh)) for x in self.models.log_probabilities(points, places).T]
        sums.append(np.bincount(owner, minlength=len(fresh)))
        return np.stack(sums, axis=1)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text: the sum for each language, and the number of characters."""
        out = np.zeros((len(texts), len(self.models.letters) + 1))
        for part in _slices([len(t or "") for t in texts], self.TEXTS_AT_ONCE):
            rows = [words_of(t) for t in texts[part]]
            self.add(rows)
            for i, words in enumerate(rows):
                if words:
                    out[part.start + i] = self.sums[np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))].sum(axis=0)
        return out


def train(docs: DataFrame, max_train: int = MAX_TRAIN, max_calibrate: int = MAX_CALIBRATE) -> dict:
    """Models, limits and temperature from the rows of docs that aren't held out and have a language."""
    rows = docs.select("doc_id", "text", "lang").where("text is not null and lang <> ''").where(F.length("text") <= MAX_CHARS).where(~held_out())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    share = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, F.lit(min((max_train + max_calibrate) / n, 1.0))).otherwise(share)
    share_of = share_order("doc_id")
    picked = rows.where(share_of < share).withColumn("part", share_of / share).orderBy("part").collect() if counts else []
    split = max_train / (max_train + max_calibrate)
    small = {k for k, n in counts.items() if n < max_train + max_calibrate}

    def learn(of: set[str], unless: int | None = None) -> dict[str, CharModel]:
        """Models of some languages; small ones leave out one fold."""
        words: dict[str, list[str]] = {}
        for r in picked:
            if r["lang"] in of and (int(r["part"] * FOLDS) != unless if r["lang"] in small else r["part"] < split) and (got := words_of(r["text"])):
                words.setdefault(r["lang"], []).extend(got)
        return {k: CharModel(v) for k, v in words.items()}

    models = learn(set(counts))
    names = sorted(models)
    guess = [(float(np.log(models[k].letters)), 0.0, 0.0) for k in names]
    limits, temperature = {k: (*x, 0.0) for k, x in zip(names, guess, strict=True)}, 1.0
    scored = []  # of calibration texts: cross-entropies under all languages, the right one, and their characters
    for fold in [None, *(range(FOLDS) if small else [])]:
        fresh = models if fold is None else learn(small, fold)
        rest = [r for r in picked if r["lang"] in fresh and (r["lang"] not in small and r["part"] >= split if fold is None else int(r["part"] * FOLDS) == fold)]
        if rest:
            got = Scorer(models | fresh).score([r["text"] for r in rest])
            use = got[:, -1] > 0
            scored.append((got[use, :-1] / got[use, -1:], np.array([names.index(r["lang"]) for r in rest])[use], got[use, -1]))
    shuffled = []  # of known negatives: cross-entropy under the language they are taken for, and that language
    rng = random.Random(SEED)
    for lang in names:
        some = [r["text"] for r in picked if r["lang"] == lang][:SHUFFLED]
        got = Scorer(models).score([shuffle_letters(t, rng) for t in some])
        got = got[got[:, -1] > 0]
        per = got[:, :-1] / got[:, -1:]
        shuffled += [(-float(p.max()), int(p.argmax())) for p in per]
    if scored and sum(map(len, (t for _, t, _ in scored))):
        per, truth, sizes = (np.concatenate(x) for x in zip(*scored, strict=True))
        limits = calibrate(names, -per.max(axis=1), per.argmax(axis=1), sizes)  # what a text is taken for, as labels may be wrong
        losses = []
        for t in TEMPERATURES:
            z = per / t
            z -= z.max(axis=1, keepdims=True)
            losses.append((-(z[np.arange(len(z)), truth] - np.log(np.exp(z).sum(axis=1))).mean() if len(z) else 0.0, t))
        temperature = min(losses)[1]
    every = [h for h, _ in shuffled]
    own = {k: [h for h, i in shuffled if i == names.index(k)] for k in names}
    noise = {k: float(np.median(x if len(x) >= ENOUGH else every)) if every else limits[k][0] for k, x in own.items()}
    return {"models": models, "limits": limits, "noise": noise, "temperature": temperature}


def shuffle_letters(text: str, rng: random.Random) -> str:
    """The text's words with all of its letters in another order."""
    words = words_of(text)
    letters = list("".join(words))
    rng.shuffle(letters)
    ends = np.cumsum(list(map(len, words))).tolist()
    return " ".join("".join(letters[b - len(w) : b]) for w, b in zip(words, ends, strict=True))


def spread(entropies: np.ndarray, sizes: np.ndarray) -> tuple[float, float, float]:
    """Mean of cross-entropies, and a and b of their variance a + b / characters."""
    mean = float(entropies.mean())
    square, inverse = (entropies - mean) ** 2, 1.0 / sizes
    (a, b), *_ = np.linalg.lstsq(np.stack((np.ones(len(sizes)), inverse), axis=1), square, rcond=None)
    if a < 0:
        a, b = 0.0, float(square @ inverse / (inverse @ inverse))
    elif b < 0:
        a, b = float(square.mean()), 0.0
    return mean, max(float(a), LEAST_DEVIATION**2), float(b)


def usual(entropies: np.ndarray) -> np.ndarray:
    """Which cross-entropies are no odd ones: up to the quantile of TRIMMED, and as far again from the median."""
    middle, high = np.quantile(entropies, (0.5, TRIMMED))
    return entropies <= middle + 2 * max(high - middle, LEAST_DEVIATION)


def tail_limit(distances: np.ndarray) -> float:
    """Where a tail that falls exponentially through the 75th and 95th percentile leaves BEYOND of the texts."""
    low, high = np.quantile(distances, (0.75, 0.95))
    return max(float(high + (high - low) * math.log(0.05 / BEYOND) / math.log(5)), LEAST_LIMIT)


def calibrate(names: list[str], entropies: np.ndarray, truth: np.ndarray, sizes: np.ndarray) -> dict[str, tuple[float, ...]]:
    """Mean, a and b of the variance, and the limit in standard deviations, of each language."""
    counts = np.bincount(truth, minlength=len(names))

    def spread_of(rows: np.ndarray) -> tuple[float, float, float]:
        rows = rows[usual(entropies[rows])]
        return spread(entropies[rows], sizes[rows])

    enough = np.flatnonzero(np.isin(truth, np.flatnonzero(counts >= ENOUGH)))
    pooled = spread_of(enough if len(enough) else np.arange(len(truth)))
    spreads, distances = [], np.zeros(len(truth))
    for i in range(len(names)):
        own = np.flatnonzero(truth == i)
        found = spread_of(own) if len(own) else pooled
        spreads.append(found if counts[i] >= ENOUGH else tuple(map(max, found, pooled)))
        mean, a, b = spreads[-1]
        distances[own] = (entropies[own] - mean) / np.sqrt(a + b / sizes[own])
    every = tail_limit(distances)
    return {k: (*spreads[i], tail_limit(distances[truth == i]) if counts[i] >= OWN_TAIL else every) for i, k in enumerate(names)}


def judge_texts(scorer: Scorer, model: dict, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
    """Language, score, cross-entropy and rejection of each text."""
    names, out = sorted(model["models"]), []
    for row in scorer.score(texts):
        n = row[-1]
        if not n or not names:
            out.append((UNDETERMINED, 0.0, None, True))
            continue
        per = row[:-1] / n
        best = int(np.argmax(per))
        z = np.exp((per - per[best]) / model["temperature"])
        mean, a, b, deviations = model["limits"][names[best]]
        halfway = mean + (0.5 + 1 / np.sqrt(n)) * max(model["noise"][names[best]] - mean, 0.0)
        limit = max(mean + deviations * np.sqrt(a + b / n), halfway)
        out.append((names[best], float(1.0 / z.sum()), float(-per[best]), bool(-per[best] > limit)))
    return out


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy and rejected of every row of docs."""
    schema = "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean"

    def make():
        scorer = Scorer(model["models"])

        def step(batch: dict) -> dict:
            lang, score, entropy, rejected = map(list, zip(*judge_texts(scorer, model, batch["text"]), strict=True))
            return {"doc_id": batch["doc_id"], "lang_pred": lang, "score": score, "cross_entropy": entropy, "rejected": rejected}

        return step

    return map_batches(docs.select("doc_id", "text"), make, schema).withColumn("held_out", held_out())


def keep_known(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs that aren't rejected, with all their columns."""

    def make():
        scorer = Scorer(model["models"])
        return lambda batch: [not x[3] for x in judge_texts(scorer, model, batch.column("text").to_pylist())]

    return filter_batches(docs, make)
