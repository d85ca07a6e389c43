"""What the calibrations of the quality rules, the language limits and the URL verdicts promise."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import langid, quality, queries, urls

SF = "/root/testdata/sf0.01"


def test_copies_certify_nothing(spark):
    """Four good texts, each 400 times with small changes, and twelve bad ones: four draws are no evidence of a share of 2 in 100."""
    good = [" ".join(f"word{chr(97 + k)}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)) for k in range(4)]
    bad = [" ".join(f"ODD{chr(65 + k)}{chr(65 + i % 26)}!" for i in range(120)) + " ###" for k in range(12)]
    rows = [(n * 4 + k, good[k] + " " * (n % 3) + str(n), "en", 1) for n in range(400) for k in range(4)] + [(5000 + k, bad[k], "en", 0) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    out = quality.judge(docs.drop("quality"), docs.select("doc_id", "quality")).collect()
    assert len(out) == len(rows) and all(r["kept"] != r["base_failed"] for r in out)


def plain_kept(feats: list, labels: dict[int, int]) -> dict[int, bool]:
    """The verdicts by plain loops over the counted rows; feats: with doc_id, stratum, copy, base_failed, ratios and proposes."""
    rows: dict = {}
    for r in feats:
        if r["doc_id"] in labels and not r["base_failed"]:
            key = (r["stratum"], r["copy"])
            own = (labels[r["doc_id"]], *[r[x] for x in quality.RATIOS], r["doc_id"])
            rows[key] = min(rows.get(key, (own, r["proposes"])), (own, r["proposes"]))
    bins = lambda own: [min(int(np.floor(x * quality.BINS)), quality.BINS) for x in own]
    tables = np.zeros((len(quality.RATIOS), quality.BINS + 1))
    proposing = [(own[0] > 0, bins(own[1:-1])) for own, half in rows.values() if half]
    n_good, n_bad = sum(g for g, _ in proposing), sum(not g for g, _ in proposing)
    for i in range(len(quality.RATIOS)):
        for b in range(quality.BINS + 1):
            bad, good = (sum(x[i] >= b for g, x in proposing if g == kind) for kind in (False, True))
            tables[i, b] = round(float(np.log((bad + 1) / (n_bad + 1) / ((good + 1) / (n_good + 1)))), 6)
    evidence = lambda own: max(tables[i, b] for i, b in enumerate(bins(own)))
    counts = Counter((s, half, own[0] > 0, float(evidence(own[1:-1]))) for (s, _), (own, half) in rows.items())
    cutoffs = quality.certify([{"stratum": s, "proposes": half, "good": good, "evidence": e, "count": n} for (s, half, good, e), n in counts.items()])
    return {r["doc_id"]: not (r["base_failed"] or evidence([r[x] for x in quality.RATIOS]) >= cutoffs.get(r["stratum"], np.inf)) for r in feats}


def test_kept_equals_plain_loops(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.where("doc_id < 4000 and lang <> 'es'")
    copy = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("stratum"), quality.same_words(F.col("text")).alias("copy"), (quality.share_order("copy") < 0.5).alias("proposes"))
    out = quality.judge(docs, labels)
    want = plain_kept(out.join(copy.drop("stratum"), "doc_id").collect(), {r["doc_id"]: r["quality"] for r in labels.collect()})
    got = {r["doc_id"]: r["kept"] for r in out.collect()}
    assert got == want and any(not k for k in got.values())


def test_one_odd_text_moves_no_limit():
    rng = np.random.default_rng(9)
    sizes, truth = rng.integers(200, 4000, 800), np.repeat([0, 1], 400)
    entropies = 2 + 0.3 * truth + rng.normal(0, np.sqrt(0.002 + 4 / sizes))
    at = {}
    for odd in (None, 3.0, 9.0, 40.0):
        e = entropies.copy()
        if odd:
            e[5] = odd
        limits = langid.calibrate(["a", "b"], e, truth, sizes)
        at[odd] = [limits[k][0] + limits[k][3] * np.sqrt(limits[k][1] + limits[k][2] / 1000) for k in "ab"]
    assert all(abs(x - y) < 0.06 for odd in (3.0, 9.0, 40.0) for x, y in zip(at[odd], at[None], strict=True))
    assert at[9.0] == at[40.0]  # how odd doesn't matter


def test_limits_keep_what_is_learnt_and_reject_what_is_not(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs)
    odd = ["De snelle bruine vos springt over de luie hond en rent naar huis terwijl de kinderen in de tuin spelen met een grote rode bal", "La volpe veloce salta sopra il cane pigro e corre verso casa mentre i bambini giocano nel giardino con una grande palla", "Съешь же ещё этих мягких французских булок да выпей чаю " * 20, "zqxj vvkw qqzt xkcd jjhh wwvx zzqy kkpq " * 30]
    asked = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(-i - 1, t, "en") for i, t in enumerate(odd)], "doc_id long, text string, lang string"))
    out = {r["doc_id"]: r for r in langid.predict(asked, model).collect()}
    assert all(out[-i - 1]["rejected"] for i in range(len(odd)))
    assert not any(r["rejected"] for i, r in out.items() if i >= 0 and r["lang_pred"] != langid.UNDETERMINED)


@pytest.mark.parametrize("fold", range(4))
def test_verdicts_on_hosts_that_no_rule_told(spark, fold):
    """The rules are hidden on a quarter of the hosts: their verdicts must come back from the lexical features alone."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    rule, verdict = urls.rule_columns(queries.URL_RULES)
    truth = urls.with_parts(pages).withColumn("truth", verdict).withColumn("held", F.pmod(F.crc32(F.col("host").cast("binary")), F.lit(4)) == fold)
    hidden = truth.where("held and truth is not null")
    known = truth.where("not held or truth is null").select("page_id", "url")
    rules = queries.URL_RULES
    moved = hidden.select((-F.col("page_id") - 1).alias("page_id"), F.regexp_replace("url", "^[a-z]+://", "x://").alias("url"))
    out = judged_without_rules(known, moved, rules)
    both = out.join(hidden.select((-F.col("page_id") - 1).alias("page_id"), "truth"), "page_id").collect()
    right = [r for r in both if r["verdict"] == r["truth"]]
    block = [r for r in both if r["truth"] == "block"]
    FOUND[fold] = (len(right), len(both), sum(r["verdict"] == "block" for r in block), len(block))
    if len(FOUND) == 4:
        ok, n, hit, n_block = map(sum, zip(*FOUND.values(), strict=True))
        assert ok / n >= 0.8 and hit / n_block >= 0.7


FOUND: dict[int, tuple[int, int, int, int]] = {}


def judged_without_rules(known, moved, rules):
    """Verdicts on moved by a model of known: its rows are marked, so that no rule fits them."""
    original = urls.rule_columns

    def marked(given):
        rule, verdict = original(given)
        free = ~F.col("url").startswith("x://")
        return F.when(free, rule), F.when(free, verdict)

    urls.rule_columns = marked
    try:
        return urls.judge(known.unionByName(moved), rules).where("page_id < 0").select("page_id", "verdict")
    finally:
        urls.rule_columns = original


def test_trees_in_sql_equal_trees_in_numpy(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, len(urls.FEATURES))).round(3)
    y = (x[:, 0] + x[:, 3] * x[:, 9] > 0.2).astype(float)
    base, trees = urls.fit_trees(x, y)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i int, " + ", ".join(f"{f} double" for f in urls.FEATURES))
    score = F.lit(base)
    for t in trees:
        score = score + urls.tree_column(t)
    got = [r["s"] for r in df.select("i", score.alias("s")).orderBy("i").collect()]
    assert np.allclose(got, urls.tree_scores(base, trees, x))


def test_cut_is_the_best_out_of_fold():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3)).round(2)
    y = (x[:, 0] > 0.8).astype(float)
    folds, weights = rng.integers(0, 5, 400), rng.integers(1, 5, 400)
    cut = urls.calibrated_cut(x, y, weights, folds)
    scores = np.zeros(400)
    for f in range(5):
        scores[folds == f] = urls.tree_scores(*urls.fit_trees(x[folds != f], y[folds != f], weights[folds != f]), x[folds == f])
    right = lambda c: weights[(scores > c) == (y > 0)].sum()
    assert right(cut) == max(right(c) for c in [*scores, scores.min() - 1])
