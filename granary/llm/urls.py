"""URL verdicts: host and path rules first, then gradient-boosted trees on lexical features.

In DataFrame functions only. The trees learn from the URLs that a rule judges: at most about MAX_TRAIN distinct ones, picked
by a hash of the URL, each with the number of its rows as weight. Their features (length, depth, digit ratio, entropy, parameter
counts, host labels, and how often hosts are blocked whose suffix, domain or first section of the path is the same) come to the
driver, where histogram boosting fits shallow trees with the logistic loss; the trees become one SQL expression.

The statistics are of all labelled URLs. What the trees learn from is out of fold: each URL comes with statistics that leave
out the URLs of its own fold, with those that leave out all URLs of its host's fold, and with those of the first kind without
the section's. So the trees see what a known host, a new host and a new section will bring. The cut of the score is the one
that judges most rows right when the hosts of each fold are scored by trees of the other hosts. The statistics are written to
work tables, so that Spark joins them by broadcast only if they are small.

Defined results: a null url, or one without `://`, has empty host and path, fits no rule, and gets the trees' verdict on
an empty host; where the labelled URLs have no or only one verdict, that one (allow, if none) is given to all others.
Repeated rows each give their row; two rules of one length that both fit: the first in alphabetical order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, share_order, sql_ascii_lower

MAX_TRAIN = 20_000
ROUNDS, DEPTH, RATE, BINS, RIDGE = 20, 3, 0.3, 16, 1.0
PRIOR_WEIGHT = 5.0
FEATURES = ("length", "depth", "digit_ratio", "entropy", "params", "labels", "hyphens", "path_length", "suffix_rate", "domain_rate", "section_rate", "domain_seen")
STATISTICS, FOLDS = ("suffix", "domain", "section"), 5


def with_parts(pages: DataFrame) -> DataFrame:
    """Adds host (A-Z in lower case) and path of the url."""
    at = F.locate("://", F.coalesce("url", F.lit("")))
    rest = F.when(at > 0, F.substring("url", at + 3, F.length("url"))).otherwise(F.lit(""))
    host = sql_ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumn("host", host).withColumn("path", path)


def rule_columns(rules: dict[str, str]) -> tuple[Column, Column]:
    """The rule that fits (like `net/`) and its verdict; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for text in sorted(rules, key=lambda r: (-len(r), r), reverse=True):
        domain, _, path = text.partition("/")
        fits = ((F.col("host") == domain) | F.col("host").endswith("." + domain)) & F.col("path").startswith("/" + path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(rules[text])).otherwise(verdict)
    return rule, verdict


def with_features(pages: DataFrame) -> DataFrame:
    """Adds the lexical features of url, host and path, and the host's suffixes of one and two labels."""
    url = F.coalesce(F.col("url"), F.lit(""))
    n = F.greatest(F.length(url), F.lit(1))
    df = pages.withColumn("_url", url).withColumn("_chars", F.array_distinct(F.split(url, "")))
    counts = F.transform("_chars", lambda c: (F.length("_url") - F.length(F.replace(F.col("_url"), c, F.lit("")))).cast("double"))
    entropy = F.aggregate(F.filter(counts, lambda c: c > 0), F.lit(0.0), lambda s, c: s - c / n * F.log2(c / n))
    count = lambda column, c: F.length(column) - F.length(F.replace(F.col(column), F.lit(c), F.lit("")))
    digits = F.length(F.regexp_replace("_url", "[^0-9]", ""))
    columns = {
        "length": F.length("_url"), "depth": count("path", "/"), "digit_ratio": digits / n, "entropy": F.round(entropy, 9), "params": count("_url", "&") + count("_url", "?"),
        "labels": count("host", "."), "hyphens": count("_url", "-"), "path_length": F.length("path"),
    }
    df = df.withColumns({k: c.cast("double") for k, c in columns.items()})
    return with_suffixes(df).drop("_url", "_chars")


#: How the rows that the trees learn from get their statistics: without the URLs of which fold, and without which statistic.
VIEWS = (("url_fold", None), ("host_fold", None), ("url_fold", "section"))


def with_suffixes(pages: DataFrame) -> DataFrame:
    """Adds the host's suffixes of one and two labels, the first section of the path, and the folds of host and url."""
    fold = lambda c: F.pmod(F.xxhash64(c), F.lit(FOLDS)).cast("int")
    section = F.regexp_extract("path", "^/([^/]*)/", 1)
    return pages.withColumns({"suffix": F.substring_index("host", ".", -1), "domain": F.substring_index("host", ".", -2), "section": section, "host_fold": fold("host"), "url_fold": fold("url")})


def statistics(labelled: DataFrame, column: str) -> DataFrame:
    """Rows and blocked rows of each value of a column, by the folds of host and url; labelled: n rows of each url."""
    return with_suffixes(labelled).groupBy(column, "host_fold", "url_fold").agg(F.sum("n").alias("seen"), F.sum(F.col("blocked") * F.col("n")).alias("blocked"))


def with_rates(df: DataFrame, tables: dict[str, DataFrame], prior: float, without: str | None = None, blank: str | None = None) -> DataFrame:
    """Adds the rates of df's suffix, domain and section, drawn towards the common rate, and how often the domain was seen.

    without: the kind of fold of which a row's own is left out; blank: a statistic that is left out.
    """
    for c, table in tables.items():
        sums = lambda *by, n: table.groupBy(*by).agg(F.sum("seen").alias(f"_seen{n}"), F.sum("blocked").alias(f"_blocked{n}"))  # noqa: B023, E731
        df = df.join(sums(c, n=1), c, "left")
        seen, blocked = (F.coalesce(x, F.lit(0)) for x in ("_seen1", "_blocked1"))
        if without:
            df = df.join(sums(c, without, n=2), [c, without], "left")
            seen, blocked = (a - F.coalesce(b, F.lit(0)) for a, b in ((seen, "_seen2"), (blocked, "_blocked2")))
        if c == blank:
            seen = blocked = F.lit(0)
        df = df.withColumn(f"{c}_rate", F.round((blocked + PRIOR_WEIGHT * prior) / (seen + PRIOR_WEIGHT), 9))
        if c == "domain":
            df = df.withColumn("domain_seen", F.round(F.log1p(seen.cast("double")), 9))
        df = df.drop("_seen1", "_blocked1", "_seen2", "_blocked2")
    return df


def weighted_cuts(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Distinct inner quantiles, each value as often as its weight says."""
    order = np.argsort(values, kind="stable")
    ends = np.cumsum(weights[order])
    places = np.floor(np.linspace(0, 1, BINS + 1)[1:-1] * (ends[-1] - 1))
    return np.unique(values[order][np.searchsorted(ends, places, "right")])


def fit_trees(x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None) -> tuple[float, list]:
    """Base score and trees; a tree is a number or (feature, threshold, tree up to it, tree beyond it)."""
    weights = np.ones(len(y), np.int64) if weights is None else weights
    share = float(np.clip(np.average(y, weights=weights), 1e-6, 1 - 1e-6))
    base = float(np.log(share / (1 - share)))
    cuts = [weighted_cuts(x[:, j], weights) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    score, trees = np.full(len(y), base), []

    def grow(rows: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int):
        g, h = grad[rows].sum(), hess[rows].sum()
        best = (1e-6, None)
        if depth:
            for j, c in enumerate(cuts):
                gl = np.cumsum(np.bincount(bins[rows, j], grad[rows], len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(bins[rows, j], hess[rows], len(c) + 1))[:-1]
                gain = gl**2 / (hl + RIDGE) + (g - gl) ** 2 / (h - hl + RIDGE) - g**2 / (h + RIDGE)
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), (j, int(gain.argmax())))
        if best[1] is None:
            value = float(-RATE * g / (h + RIDGE))
            score[rows] += value
            return value
        j, k = best[1]
        low = bins[rows, j] <= k
        return (j, float(cuts[j][k]), grow(rows[low], grad, hess, depth - 1), grow(rows[~low], grad, hess, depth - 1))

    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        trees.append(grow(np.arange(len(y)), weights * (p - y), weights * p * (1 - p), DEPTH))
    return base, trees


def tree_column(tree, names: tuple[str, ...] = FEATURES) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    j, cut, low, high = tree
    return F.when(F.col(names[j]) <= cut, tree_column(low, names)).otherwise(tree_column(high, names))


def tree_scores(base: float, trees: list, x: np.ndarray) -> np.ndarray:
    """What tree_column says, for rows of an array."""

    def value(tree, rows: np.ndarray) -> np.ndarray:
        if isinstance(tree, float):
            return np.full(len(rows), tree)
        j, cut, low, high = tree
        return np.where(rows[:, j] <= cut, value(low, rows), value(high, rows))

    return base + sum((value(t, x) for t in trees), np.zeros(len(x)))


def calibrated_cut(x: np.ndarray, y: np.ndarray, weights: np.ndarray, folds: np.ndarray) -> float:
    """The cut of scores that judges most rows right, each fold scored by trees of the others; of equal cuts the one nearest 0."""
    scores = np.zeros(len(y))
    for f in np.unique(folds):
        rest = folds != f
        if len(set(y[rest])) == 2:
            scores[~rest] = tree_scores(*fit_trees(x[rest], y[rest], weights[rest]), x[~rest])
    order = np.argsort(scores, kind="stable")
    values, right = scores[order], np.where(y[order] > 0, -weights[order], weights[order])  # a cut above a row allows it
    ends = np.flatnonzero(np.diff(values) > 0)
    cuts = np.concatenate(([values[0] - 1], (values[ends] + values[ends + 1]) / 2, [values[-1] + 1], [0.0]))
    gain = np.append(0, np.cumsum(right))[np.searchsorted(values, cuts, "right")]
    best = cuts[gain == gain.max()]
    return float(best[np.abs(best).argmin()])


def judge(pages: DataFrame, rules: dict[str, str], max_train: int = MAX_TRAIN) -> DataFrame:
    """page_id, host, path, rule, verdict and score (log-odds of block above the cut; null where no model could be trained)."""
    rule, by_rule = rule_columns(rules)
    parts = with_parts(pages.select("page_id", "url")).withColumn("rule", rule).withColumn("by_rule", by_rule)
    known = parts.where("by_rule is not null").withColumn("blocked", (F.col("by_rule") == "block").cast("int"))
    labelled = materialize(known.groupBy("url", "host", "path", "blocked").agg(F.count("*").alias("n")), "labelled-urls")
    totals = labelled.groupBy("blocked").agg(F.sum("n").alias("n"), F.count("*").alias("distinct")).collect()
    sizes = {r["blocked"]: r["n"] for r in totals}
    if len(sizes) < 2:
        only = "block" if sizes.get(1) else "allow"
        return parts.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.lit(only)).alias("verdict"), F.lit(None).cast("double").alias("score"))
    prior = sizes[1] / sum(sizes.values())
    tables = {c: materialize(statistics(labelled, c), f"{c}-statistics") for c in STATISTICS}
    sample = with_features(labelled.where(share_order("url") < max_train / sum(r["distinct"] for r in totals)).withColumnRenamed("blocked", "label"))
    views = [with_rates(sample, tables, prior, *v).select(*FEATURES, "label", "host_fold", "n") for v in VIEWS]
    views = views[0].unionByName(views[1]).unionByName(views[2]).groupBy(*FEATURES, "label", "host_fold").agg(F.sum("n").alias("n"))
    rows = views.orderBy(*FEATURES, "label", "host_fold").collect()  # max_train URLs for each view, about
    x, y = np.array([[r[f] for f in FEATURES] for r in rows]), np.array([float(r["label"]) for r in rows])
    weights, folds = np.array([r["n"] for r in rows]), np.array([r["host_fold"] for r in rows])
    base, trees = fit_trees(x, y, weights)
    score = F.lit(base - calibrated_cut(x, y, weights, folds))
    for tree in trees:
        score = score + tree_column(tree)
    scored = with_rates(with_features(parts), tables, prior).withColumn("score", score)
    verdict = F.coalesce("by_rule", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
