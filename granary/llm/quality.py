"""Quality rules with risk-controlled thresholds.

Base counters of each text give ratios (the higher, the worse). The evidence of a ratio is the logarithm of how much more
often bad documents reach it than good ones do, from labelled documents (quality 1: good, 0: bad); a document's evidence is
the strongest of its ratios. Each stratum (the language column) gets a cutoff of the evidence: one half of its labelled
documents, those that also tell the evidence, proposes the cutoff that parts bad from good best (the greatest difference of
the shares that go), of those that the half itself would certify; the other, held-out half tests it. With k of its n good
documents at or beyond the cutoff, the exact binomial tail P(Bin(n, ALPHA) <= k) is the p-value of "the cutoff rejects more
than a share ALPHA of good documents"; Holm's correction over all strata keeps the chance of any wrong cutoff under DELTA. A
cutoff that isn't certified isn't used. As the tail is that of independent draws, copies are one document: texts with the same
words (whatever the case, white space, digits and signs) count once in a stratum, and are in the same half.

The labels enter as histograms of fixed bins, counted over all labelled documents in Spark; only these reach the driver.

Defined results: a null text has no words; texts of under MIN_WORDS words fail the base rule; texts of any length are counted
whole; a null language is a stratum of its own, as the empty one; a stratum without a certified cutoff keeps all that pass
the base rule; labels of one document, or of one text in a stratum, that contradict each other count as bad, null labels
count for nothing; without labels no evidence rejects anything. Repeated rows, and rows of one doc_id, each are judged by their own text. Other columns stay as
they are in keep_good, whatever their names, and are left out by judge.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from .common import ROWS_AT_ONCE, WORD, frugal, materialize, share_order

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
ALPHA, DELTA = 0.02, 0.1
BINS = 200
RATIOS = ("symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "exclaim_ratio")
SYMBOLS = "#*$%&|<>"
NO_STRATUM = ""


def count_repeat_words(words: list[str]) -> int:
    """Words that lie in a window of three words found twice or more in the text."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    twice = {w for w, n in Counter(windows).items() if n > 1}
    marked = np.fromiter((w in twice for w in windows), bool, len(windows))
    out = np.zeros(len(words), bool)
    for k in range(3):
        out[k : k + len(marked)] |= marked
    return int(out.sum())


def counters(text: str | None) -> tuple[int, int, int, int, int, list[float]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the ratios."""
    text = text or ""
    words = WORD.findall(text)
    chars, symbols = sum(map(len, words)), sum(map(text.count, SYMBOLS))
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    repeats, n = count_repeat_words(words), max(len(words), 1)
    ratios = [symbols / max(chars, 1), dup / len(lines), repeats / n, sum(map(str.isupper, words)) / n, text.count("!") / n]
    return len(words), chars, symbols, dup, repeats, ratios


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


COUNTERS = [
    *[StructField(c, LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
    StructField("base_failed", BooleanType()),
    *[StructField(r, DoubleType()) for r in RATIOS],
]


def with_counters(docs: DataFrame, prefix: str = "") -> DataFrame:
    """The rows of docs with the counters and ratios of their text."""
    fields = [StructField(prefix + f.name, f.dataType) for f in COUNTERS]
    added = to_arrow_schema(StructType(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(begin, ROWS_AT_ONCE)
                rows = []
                for text in part.column("text").to_pylist():
                    *base, ratios = counters(text)
                    rows.append((*base, base_failed(base[0], base[4]), *ratios))
                for field, values in zip(added, zip(*rows, strict=True), strict=True):
                    part = part.append_column(field, pa.array(values, field.type))
                yield part

    return docs.mapInArrow(frugal(run), StructType([*docs.schema.fields, *fields]))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), exactly summed."""
    if n == 0 or k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def bin_of(ratio) -> Column:
    return F.least(F.floor(ratio * BINS), F.lit(BINS)).cast("int")


def same_words(text) -> Column:
    """A hash of a text's letters in lower case; copies that differ in white space, digits and signs have the same."""
    return F.xxhash64(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))


def labelled(feats: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows that pass the base rule, one for each text of a stratum, with their label and half."""
    labels = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = feats.where("not base_failed").select("doc_id", "stratum", "copy", *RATIOS).join(labels, "doc_id")
    worst = F.min(F.struct("quality", *RATIOS, "doc_id")).alias("own")  # partial sums in each task: copies don't meet as rows
    rows = rows.groupBy("stratum", "copy").agg(worst).select("stratum", "own.*", (share_order("copy") < 0.5).alias("proposes"))
    return rows.withColumn("good", F.col("quality") > 0)


def weigh(counts: list) -> np.ndarray:
    """The evidence of each ratio's bins, from counts of documents by ratio, bin and label."""
    hist = np.zeros((len(RATIOS), 2, BINS + 1), np.int64)
    for r in counts:
        hist[r["ratio"], int(r["good"]), r["bin"]] += r["count"]
    reach = hist[:, :, ::-1].cumsum(axis=2)[:, :, ::-1]  # documents in this bin or a higher one
    share = (reach + 1) / (reach[:, :, :1] + 1)
    return np.round(np.log(share[:, 0] / share[:, 1]), 6)


def certify(counts: list, alpha: float = ALPHA, delta: float = DELTA) -> dict[str, float]:
    """The cutoffs that pass the test, by stratum, from counts of documents by stratum, half, label and evidence."""
    strata: dict = {}
    for r in counts:
        own = strata.setdefault(r["stratum"], {}).setdefault((r["proposes"], r["good"]), Counter())
        own[r["evidence"]] += r["count"]

    def beyond(own: dict, half: bool, good: bool, cut: float) -> tuple[int, int]:
        some = own.get((half, good), Counter())
        return sum(n for x, n in some.items() if x >= cut), some.total()

    tests = []
    for stratum, own in sorted(strata.items()):
        best = (0.0, 0.0)
        for cut in sorted(x for x in set().union(*own.values()) if x > 0):
            (bad, n_bad), (good, n_good) = beyond(own, True, False, cut), beyond(own, True, True, cut)
            if binomial_tail(good, n_good, alpha) <= delta / len(strata):
                best = max(best, (bad / max(n_bad, 1) - good / n_good, cut))
        if best[0] > 0:
            tests.append((binomial_tail(*beyond(own, False, True, best[1]), alpha), stratum, best[1]))
    out = {}
    for i, (p, stratum, cut) in enumerate(sorted(tests)):
        if p > delta / (len(tests) - i):
            break
        out[stratum] = cut
    return out


def evidence(weights: np.ndarray) -> Column:
    """The strongest evidence of a row's ratios."""
    return F.greatest(*[F.element_at(F.array(*map(F.lit, w.tolist())), bin_of(F.col(r)) + 1) for r, w in zip(RATIOS, weights, strict=True)])


def with_verdict(feats: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds evidence and kept to rows that have counters, ratios and stratum."""
    rows = labelled(feats, labels)
    bins = F.array(*[F.struct(F.lit(i).alias("ratio"), bin_of(F.col(r)).alias("bin")) for i, r in enumerate(RATIOS)])
    weights = weigh(rows.where("proposes").select("good", F.explode(bins).alias("x")).groupBy("x.ratio", "x.bin", "good").count().collect())
    feats, rows = (df.withColumn("evidence", evidence(weights)) for df in (feats, rows))
    cutoffs = certify(rows.groupBy("stratum", "proposes", "good", "evidence").count().collect())  # bounded by the bins of all ratios
    bad = F.col("base_failed")
    for stratum, cut in sorted(cutoffs.items()):
        bad = bad | ((F.col("stratum") == stratum) & (F.col("evidence") >= cut))
    return feats.withColumn("kept", ~bad)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counters, ratios, evidence and verdict of every row of docs."""
    feats = with_counters(docs.select("doc_id", "text", same_words(F.col("text")).alias("copy"), F.coalesce("lang", F.lit(NO_STRATUM)).alias("stratum"))).drop("text")
    return with_verdict(materialize(feats, "quality"), labels).drop("copy")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all their columns; texts are counted once, into a work table."""
    free = "_" * (1 + max(map(len, docs.columns)))
    written = materialize(with_counters(docs, free), "counted")
    names = [f"{free}{f.name}" for f in COUNTERS]
    renamed = {n: F.col(n).alias(n[len(free) :]) for n in names}
    feats = written.select("doc_id", same_words(F.col("text")).alias("copy"), F.coalesce("lang", F.lit(NO_STRATUM)).alias("stratum"), F.struct(*docs.columns).alias("row"), *renamed.values())
    return with_verdict(feats, labels).where("kept").select("row.*")
