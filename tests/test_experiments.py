"""Feedback rounds, scores of contexts, timed jobs and name matching against plain models."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as t

from granary.functions import text as T
from granary.operators import experiments, index, retrieval
from granary.plans import catalogue
from granary.sources.versions import Results


def table(a, b):
    rows = [[0] * (len(b) + 1)]
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(rows[-1][j] + 1 if x == y else max(rows[-1][j + 1], row[-1]))
        rows.append(row)
    return rows[-1][-1]


def test_common_subsequence():
    rng = random.Random(2)
    for n in (0, 1, 5, 70, 200):
        for kinds in (2, 20):
            a, b = ([f"w{rng.randrange(kinds)}" for _ in range(rng.randint(0, n))] for _ in range(2))
            assert experiments.common_subsequence(a, b) == table(a, b)


def test_context_scores(spark):
    rows = [(1, "a b c d", "a b x", ["a b z", "q", "a c b d"]), (2, "a b", "a", []), (3, "", None, ["a"]), (4, "a b", "b a", None), (5, "One two.", "TWO", [None, "one, two"])]
    df = spark.createDataFrame(rows, "k long, reference string, answer string, contexts array<string>")
    got = {r["k"]: tuple(r)[1:] for r in experiments.context_scores(df, "k").collect()}
    # worths 2/4, 0, 3/4: relevant at ranks 1 and 3
    assert got[1] == (round((1 + 2 / 3) / 2, 6), 0.75, round(2 / 3, 6))
    assert got[2] == got[3] == got[4] == (0.0, 0.0, 0.0) and got[5] == (0.5, 1.0, 1.0)
    assert experiments.context_scores(df.limit(0), "k").collect() == []


def test_failed_jobs_count_as_zero(spark, tmp_path):
    items = spark.createDataFrame([(i,) for i in range(10)], "item_id long")
    kept = Results(spark, str(tmp_path / "runs"), experiments.RESULT.format(metrics="score double"))

    def half(part):
        if part.where("item_id = 3").count():
            raise ValueError("no answer\nat all")
        return part.withColumn("score", F.lit(1.0))

    jobs = {"good": lambda part: part.withColumn("score", F.lit(0.5)), "half": half, "lazy": lambda part: part.withColumn("score", F.raise_error(F.lit("late")).cast("double"))}
    experiments.run_jobs(kept, jobs, items, ["score"], batches=3)
    rows = {r["pipeline"]: r for r in experiments.job_summary(kept.rows(), ["score"]).collect()}
    assert [(rows[p]["rows"], rows[p]["failed"] > 0) for p in ("good", "half", "lazy")] == [(10, False), (10, True), (10, True)]
    assert rows["good"]["avg_score"] == 0.5 and rows["lazy"]["avg_score"] == rows["lazy"]["avg_latency_seconds"] == 0.0
    assert rows["half"]["avg_score"] == 1 - rows["half"]["failed"] / 10
    assert {r["error"] for r in kept.rows().where("pipeline = 'half' and error is not null").collect()} == {"no answer"}
    before = sorted(map(str, kept.rows().where("pipeline <> 'lazy'").collect()))
    experiments.run_jobs(kept, {"lazy": jobs["good"]}, items, ["score"])
    assert sorted(map(str, kept.rows().where("pipeline <> 'lazy'").collect())) == before
    assert kept.rows().where("pipeline = 'lazy' and score = 0.5 and latency_seconds > 0").count() == 10


def test_rounds_end_when_nothing_is_new(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c"), (3, "c d"), (4, "x y"), (5, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a"), (2, "x"), (3, "nothing"), (4, None)], "item_id long, text string")
    got = experiments.search_rounds(index.lexical_index(docs, ["doc_id"]), docs, items, k=3, rounds=9).collect()
    found = {(r["item_id"], r["round"]): {x["doc_id"] for x in got if (x["item_id"], x["round"]) == (r["item_id"], r["round"])} for r in got}
    assert found == {(1, 1): {1}, (1, 2): {2}, (1, 3): {3}, (2, 1): {4}}  # from word to word, each row once


def plain_matches(names, files, spark):
    stop = set(T.NAME_STOP_WORDS)
    import re

    normal = lambda s: re.sub("[^a-z0-9]+", "", s.lower())
    tokens = lambda s: set(re.findall("[a-z0-9]+", s.lower())) - stop
    out = {}
    for n in {n for n in names if n is not None}:
        own = {f for f in files if f is not None and normal(n) and normal(f) and (normal(f) in normal(n) or normal(n) in normal(f) or len(tokens(n) & tokens(f)) >= 3)}
        out[n] = "|".join(sorted(own))
    return out


def test_name_matching_equals_all_pairs(spark):
    rng = random.Random(5)
    words = ["inc", "acme", "oil", "gas", "2022", "10k", "annual", "report", "co", "x", "ab", "north", "south", "bank", "q1", "zeta"]
    make = lambda: rng.choice([" ", "_", ""]).join(rng.choice(words) for _ in range(rng.randint(1, 6)))
    names, files = [make() for _ in range(150)] + ["", "--", None, "a"], [make() for _ in range(150)] + ["", "x", None, "annual report"]
    got = {r["name"]: r["files"] for r in retrieval.match_names(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(f,) for f in files], "file string")).collect()}
    assert got == plain_matches(names, files, spark)


def test_a_word_in_every_file_makes_few_candidates(spark):
    number = F.lpad(F.hex(F.pmod(F.xxhash64("id"), F.lit(1 << 40))), 10, "0")
    files = spark.range(2000).select(F.concat(F.lit("acme "), number, F.lit(" filing "), F.reverse(number)).alias("file"))
    names = spark.range(200).select(F.concat(F.lit("ACME_"), number).alias("name"))
    assert retrieval.name_candidates(names, files).count() <= 600  # of 400,000 pairs that share the word
    assert retrieval.match_names(names, files).where("match_class = 'confident'").count() == 200


def test_lists_and_counts(spark):
    row = spark.range(1).select(retrieval.unique_list(F.array(*[F.lit(x).cast(t.StringType()) for x in ("b", None, "a", "", "b")])).alias("x"), retrieval.count_report(F.lit(7)).alias("n")).first()
    assert row["x"] == ["b", "a"] and row["n"] == "Total chunks in knowledge base: 7"


@pytest.mark.parametrize(("given", "want"), [("yes", True), (" ON ", True), ("1", True), ("t", True), ("0", False), ("No", False), ("off", False), ("", None), ("maybe", None)])
def test_tolerant_booleans(given, want):
    from granary.sources.files import flag

    assert flag("k", {"k": given}, {}, None) is want


def test_planner_of_small_windows(spark):
    """Windows of six sentences aren't asked about; the last sentence of a window is no break."""
    from granary.operators import chunking

    docs = spark.createDataFrame([(1, " ".join(f"S{i}." for i in range(76))), (2, " ".join(f"S{i}." for i in range(7)))], "doc_id long, text string")
    planner = lambda s: F.array(F.lit(2), F.lit(5), F.size(s) - 1)
    got: dict = {}
    for r in chunking.planned(docs, planner).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r["doc_id"], []).append(r["text"].split(" ")[-1])
    assert got[2] == ["S2.", "S5.", "S6."]
    assert "S72." not in got[1][:-1]  # break 2 of a second window of six sentences, which starts at 70


def test_rerun_searches_the_index_that_is_there(spark, monkeypatch):
    """Texts are cut and packed once; the second run of two pipelines searches the same chunks."""
    made, build = [], catalogue.retrieval.lexical_index
    monkeypatch.setattr(catalogue.retrieval, "lexical_index", lambda *a: made.append(build(*a)) or made[-1])
    rows = {r["pipeline"]: r for r in catalogue.pipeline_rerun(spark, "/root/testdata/sf0.001").collect()}
    assert len(made) == 1 and set(rows) == {"fixed+traditional", "fixed+bm25", "fixed+hyde"}
