"""Index by documents, vector searches, versioned tables and planner answers against plain models."""

import json
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import ann, index, retrieval
from granary.sources.versions import Collection, Results

DOCS = "doc_id long, text string"


def tokens(text):
    return [t for t in re.findall(r"\w+", (text or "").lower()) if re.fullmatch("[a-z0-9]+", t)]


def plain_bm25(docs: list[tuple], asked: list[tuple], k: int, pad: bool = False) -> dict:
    bags = [(key, Counter(tokens(t))) for key, t in docs]
    mean, n = max(sum(sum(b.values()) for _, b in bags), 1) / len(bags), len(bags)
    df = Counter(t for _, b in bags for t in b)
    idf = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    floor = 0.25 * sum(idf.values()) / max(len(idf), 1)
    idf = {t: x if x >= 0 else floor for t, x in idf.items()}
    out = {}
    for q, text in asked:
        want, scored = Counter(tokens(text)), []
        for key, bag in bags:
            if pad or any(t in bag for t in want):
                length = sum(bag.values())
                scored.append((-round(sum(c * idf[t] * bag[t] * 2.5 / (bag[t] + 1.5 * (0.25 + 0.75 * length / mean)) for t, c in want.items() if t in bag), 6), key))
        out[q] = [(key, -s) for s, key in sorted(scored)[:k]]
    return {q: r for q, r in out.items() if r}


def by_query(rows, query="item_id", key="doc_id"):
    out: dict = {}
    for r in sorted(rows, key=lambda r: (str(r[query]), r["rank"])):
        out.setdefault(r[query], []).append((r[key], r["score"]))
    return out


def same(got: dict, want: dict) -> bool:
    return got.keys() == want.keys() and all([a for a, _ in got[q]] == [a for a, _ in want[q]] and np.allclose([b for _, b in got[q]], [b for _, b in want[q]], atol=2e-6) for q in want)


@pytest.fixture(scope="module")
def words():
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(0, 30), p=(p := 1 / np.arange(1, 61)) / p.sum())) for _ in range(300)]
    return [(i, t) for i, t in enumerate(texts)] + [(300, None), (301, texts[3]), (302, texts[3])]


@pytest.mark.parametrize(("rows", "block"), [(4_096, 50_000), (7, 20), (1, 1)])
@pytest.mark.parametrize("pad", [False, True])
def test_bm25_over_groups_and_blocks(spark, words, monkeypatch, rows, block, pad):
    monkeypatch.setattr(index, "GROUP_ROWS", rows)
    monkeypatch.setattr(index, "BLOCK_TERMS", block)
    asked = [("a", "w0 w1 w1 w5"), ("b", "w40 w41 w59 unknown"), ("c", words[3][1]), ("d", ""), ("e", None), ("f", "unknown")]
    docs, queries = spark.createDataFrame(words, DOCS).repartition(3), spark.createDataFrame(asked, "item_id string, text string")
    assert same(by_query(retrieval.bm25(docs, queries, ["doc_id"], k=4, pad=pad).collect()), plain_bm25(words, asked, 4, pad))


def test_files_of_groups_have_small_row_groups(spark, monkeypatch):
    """Also of fewer groups than the hundred from which on a Parquet writer looks at the bytes by itself."""
    monkeypatch.setattr(index, "GROUP_ROWS", 50)
    monkeypatch.setitem(index.FILE_OPTIONS, "parquet.block.size", "40000")
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{n}" for n in rng.integers(0, 5000, 80))) for i in range(2000)]
    table = index.lexical_index(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), ["doc_id"]).groups
    files = [pq.ParquetFile(f.removeprefix("file:")) for f in table.inputFiles()]
    sizes = [f.metadata.row_group(i).num_rows for f in files for i in range(f.num_row_groups)]
    assert sum(sizes) == 40 and max(sizes) <= 5
    found = [pc.sum(pc.list_value_length(table.select("sizes").toArrow().column("sizes"))).as_py(), sum(len(index.unpacked(v)["terms"]) for v in table.select("packed").toArrow().column("packed"))]
    assert found[0] == found[1] > 0


@pytest.mark.parametrize("far", [0.0, 1e6])
def test_nearest_rows_are_weighed_exactly(far):
    """Products of matrices only say which rows may be among the k: also far from zero, and with ties, the result is exact."""
    rng = np.random.default_rng(12)
    x = np.concatenate((far + rng.normal(size=(200, 8)), far + rng.integers(0, 2, (100, 8))))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("distance", pa.float64())])
    got = retrieval._best_of([pa.array(range(300), pa.int64())], pa.array(x.tolist()), pa.array([0, 250], pa.int64()), x[[0, 250]], "l2", 5, True, schema).to_pylist()
    for q in (0, 250):
        each = {i: round(float(((x[i] - x[q]) ** 2).sum()), 6) for i in range(300) if i != q}
        last = sorted(each.values())[4]
        assert {r["vec_id"]: r["distance"] for r in got if r["query_id"] == q} == {i: d for i, d in each.items() if d <= last}


def test_rows_of_one_key_are_rows(spark):
    docs = [(1, "a b"), (1, "a b"), (2, "c d e f")]
    asked = [(7, "a c")]
    got = retrieval.bm25(spark.createDataFrame(docs, DOCS), spark.createDataFrame(asked, "item_id long, text string"), ["doc_id"]).collect()
    assert same(by_query(got), plain_bm25(docs, asked, 5))


def test_searches_of_nothing(spark, words):
    docs, none = spark.createDataFrame(words[:5], DOCS), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "w0"), (2, None)], "item_id long, text string")
    for queries, rows in ((none, docs), (some, docs.limit(0)), (some.where("item_id = 2"), docs)):
        made = index.lexical_index(rows, ["doc_id"])
        assert retrieval.bm25(made, queries, ["doc_id"]).collect() == retrieval.text_vectors(made, queries).collect() == []


def test_no_exchange_of_scored_pairs(spark, words):
    """What is shuffled of a search are the best rows of each task: the limit stands below the exchange."""
    made = index.lexical_index(spark.createDataFrame(words, DOCS), ["doc_id"])
    plan = retrieval.bm25(made, spark.createDataFrame([(1, "w0")], "item_id long, text string"), ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan.split("MapInArrow")[0] and re.search(r"WindowGroupLimit.*Final[\s\S]*Exchange hashpartitioning\(item_id[\s\S]*WindowGroupLimit.*Partial[\s\S]*MapInArrow", plan)


def test_text_vectors_are_cosines_of_hashed_counts(spark, words, monkeypatch):
    import hashlib

    def vector(text):
        out = np.zeros(64)
        for t in tokens(text):
            out[int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 64] += 1
        return out

    monkeypatch.setattr(index, "GROUP_ROWS", 50)
    asked = [(1, "w0 w3 w3"), (2, words[9][1]), (3, "")]
    got = by_query(retrieval.text_vectors(index.lexical_index(spark.createDataFrame(words, DOCS), ["doc_id"]), spark.createDataFrame(asked, "item_id long, text string")).collect())
    for q, text in asked[:2]:
        v = vector(text)
        near = sorted((-round(float(v @ (d := vector(t)) / np.sqrt(v @ v) / np.sqrt(d @ d)), 6), i) for i, t in words if tokens(t))[:5]
        assert [i for i, _ in got[q]] == [i for _, i in near]
    assert 3 not in got


def test_slots_are_the_providers_buckets(spark):
    from granary.functions import providers

    terms = ["a", "word", "x9", "zeta0"]
    got = [r["b"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(terms)], "i int, t string").select("i", providers.bucket(F.col("t")).alias("b")).orderBy("i").collect()]
    assert got == index._slots(pa.array(terms)).tolist()


# Growth


def test_index_grows_by_batches(spark, words, tmp_path):
    asked = [(1, "w0 w1 w7"), (2, "w33 w50")]
    queries = spark.createDataFrame(asked, "item_id long, text string")
    kept = index.KeptIndex(spark, str(tmp_path / "index"), DOCS, ["doc_id"])
    for n, part in enumerate((words[:100], words[100:101], words[101:])):
        assert kept.add(spark.createDataFrame(part, DOCS), batch=f"batch-{n}")
        assert not kept.add(spark.createDataFrame(part, DOCS), batch=f"batch-{n}")  # a batch that comes again counts once
    want = plain_bm25(words, asked, 5)
    assert same(by_query(retrieval.bm25(kept.open(), queries, ["doc_id"]).collect()), want)
    kept.compact()
    again = index.KeptIndex(spark, str(tmp_path / "index"), DOCS, ["doc_id"])
    assert len(again.versions.current()) == 1 and again.open().rows == len(words)
    assert not again.add(spark.createDataFrame(words[:100], DOCS), batch="batch-0")  # also after compaction
    assert same(by_query(retrieval.bm25(again.open(), queries, ["doc_id"]).collect()), want)


def test_stream_can_be_searched(spark, tmp_path):
    from granary.streaming.ingest import index_stream, open_index

    spark.createDataFrame([(1, "one two"), (2, "two three")], DOCS).write.parquet(str(tmp_path / "in"))
    for part in range(2):  # what comes later joins the index
        index_stream(spark, str(tmp_path / "in"), DOCS, str(tmp_path / "out"), str(tmp_path / "at")).awaitTermination()
        spark.createDataFrame([(3 + part, "three four")], DOCS).write.mode("append").parquet(str(tmp_path / "in"))
    found = open_index(spark, str(tmp_path / "out"), DOCS)
    queries = [(1, "three")]
    got = by_query(retrieval.bm25(found, spark.createDataFrame(queries, "item_id long, text string"), ["doc_id", "chunk_index"]).collect())
    assert same(got, plain_bm25([(1, "one two"), (2, "two three"), (3, "three four")], queries, 5))


def test_collection(spark, tmp_path):
    schema = "id long, text string"
    kept = Collection(spark, str(tmp_path / "kept"), schema)
    rows = [(i, f"text {i}" if i % 4 else None) for i in range(25)]
    df = spark.createDataFrame(rows + rows[:5], schema)
    assert kept.count() == 0 and kept.rows().collect() == []
    assert kept.add(df, batch_rows=7) == 25 and len(kept.versions.commits()) > 1
    assert kept.add(df) == 0 and kept.count() == kept.rows().count() == 25
    assert kept.add(spark.createDataFrame([(3, "changed"), rows[1]], schema)) == 1
    for bad in (0, -1):
        with pytest.raises(ValueError):
            kept.add(df, batch_rows=bad)
    pages = list(kept.pages(10, ["id"]))
    assert [len(p) for p in pages][:2] == [10, 10]
    unique = Collection(spark, str(tmp_path / "unique"), schema)
    unique.add(spark.createDataFrame(rows, schema))
    assert [tuple(r) for p in unique.pages(10, ["id"]) for r in p] == rows  # pages make up the whole
    assert [r["id"] for r in unique.page(3, ["id"], (21,)).collect()] == [22, 23, 24]


def test_failed_add_leaves_the_old_version(spark, tmp_path):
    schema = "id long, text string"
    kept = Collection(spark, str(tmp_path / "kept"), schema)
    kept.add(spark.createDataFrame([(1, "a")], schema))
    with pytest.raises(ValueError):
        kept.versions.add({"rows": kept._stored()}, expect=5, numbers={"rows": 5})
    broken = spark.createDataFrame([(2, "b")], schema).withColumn("text", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        kept.add(broken)
    assert kept.count() == kept.rows().count() == 1
    assert kept.add(spark.createDataFrame([(2, "b")], schema)) == 1 and kept.count() == 2


def test_results_are_replaced_by_pipeline(spark, tmp_path):
    schema = "pipeline string, item_id long, score double"
    kept = Results(spark, str(tmp_path / "results"), schema)
    assert kept.rows().collect() == []
    kept.replace(spark.createDataFrame([(p, i, 0.5) for p in "abc" for i in range(3)], schema), ["a", "b", "c"])
    kept.replace(spark.createDataFrame([("a", 0, 0.9), ("x", 1, 1.0)], schema), ["a", "b"])  # b is empty now, x isn't asked for
    assert sorted(map(tuple, kept.rows().collect())) == [("a", 0, 0.9), ("c", 0, 0.5), ("c", 1, 0.5), ("c", 2, 0.5)]


# Vectors


@pytest.mark.parametrize("cells", [4_000_000, 30])
def test_vectors_of_any_ids_and_lengths(spark, monkeypatch, cells):
    monkeypatch.setattr(retrieval, "MATRIX_CELLS", cells)
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0, 5.0]), (3, [2.0]), (4, None), (5, [0.0, 0.0])], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(f"q{i}", v) for i, v in enumerate([[3.0, 4.0], [1.0, 0.0, 0.0, 0.0], None, [0.0]] * 3)], "query_id string, query_vector array<double>")
    got: dict = {}
    for r in retrieval.vectors(corpus, asked, "cosine", 2).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["distance"])
    assert set(got) == {f"q{i}" for i in range(12) if i % 4 != 2}
    assert got["q0"] == {1: (1, 0.6), 2: (3, 0.6)} and got["q5"] == {1: (1, 1.0), 2: (3, 1.0)} and got["q3"] == {1: (1, 0.0), 2: (2, 0.0)}
    far = {r["query_id"]: r["distance"] for r in retrieval.vectors(corpus, asked, "l2", 1).collect()}
    assert far["q0"] == 17.0 and far["q1"] == 0.0


def test_vectors_without_queries(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    none = spark.createDataFrame([], "query_id string, query_vector array<double>")
    for d in ("cosine", "l2"):
        assert retrieval.vectors(corpus, none, d).collect() == [] and retrieval.vectors(corpus.limit(0), none, d).collect() == []
        assert ann.search(ann.build(corpus, d), none).collect() == [] and ann.search(ann.build(corpus.limit(0), d), none).collect() == []


@pytest.mark.parametrize("distance", ["cosine", "l2"])
def test_recall_of_cells_and_codes(spark, distance):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (40, 16))
    x = (centres[rng.integers(0, 40, 4000)] + rng.normal(0, 0.35, (4000, 16))).round(4)
    x[1000:2400] = x[1000]  # a third of the rows are copies of one vector
    corpus = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(9999, None)], "vec_id long, embedding array<float>").repartition(5)
    asked = corpus.where("vec_id % 100 = 0 and not vec_id between 1000 and 2399").selectExpr("vec_id as query_id", "embedding as query_vector")
    found, exact = ann.search(ann.build(corpus, distance), asked), retrieval.vectors(corpus, asked, distance)
    r = ann.recall(found, exact).first()
    assert r["n_queries"] == 26 and r["recall"] >= 0.95
    nearest = {(r["query_id"], r["vec_id"]): r["distance"] for r in exact.collect()}
    assert all(nearest.get((r["query_id"], r["vec_id"]), r["distance"]) == r["distance"] for r in found.collect())  # distances are exact


def test_all_cells_and_candidates_are_exact(spark):
    corpus = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    asked = corpus.where("vec_id % 100 = 0").selectExpr("vec_id as query_id", "embedding as query_vector")
    for distance in ("cosine", "l2"):
        got = ann.search(ann.build(corpus, distance), asked, probes=10_000, candidates=10_000).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, retrieval.vectors(corpus, asked, distance).collect()))


# Answers

ANSWERS = ['{"break_after": [1, "3"]}', '{"break_after": [1, 2.0]}', '{"break_after": [1, true, false]}', '{"break_after": [1, null]}', '{"break_after": ["x", 1]}', '```json\n{"break_after": [4, 7.5]}\n```', '``` {"break_after": [2]} ``` and', "[1, 2]", '{"break_after": 3}', '{"break_after": "12"}', "no", "", '{"other": [1]}', '{"break_after": []}', '{"break_after": [-1, -2.5, " 4 ", "1_0"]}', 'here: {"break_after": [1]}', ' {"break_after": [1, [2], {"a": 1}]} ', '{"break_after": [1e2, 8]}', '{"break_after": {"1": 2}}', '{"break_after": [5, 5, 3]}', '{"break_after": [2.9, -0.9]}', None]


def answer_model(answer: str | None, coerce: bool) -> list[int]:
    try:
        body = (answer or "").strip()
        if not coerce and "```" in body:
            body = body.split("```")[1].removeprefix("json")
        entries = json.loads(body)["break_after"]
        if not isinstance(entries, list):
            return []
        numbers = [int(e) for e in entries] if coerce else [int(e) for e in entries if isinstance(e, int)]
        return [n for n in numbers if 0 <= n < 50]
    except (ValueError, TypeError, KeyError, IndexError):
        return []


@pytest.mark.parametrize("coerce", [False, True])
def test_planner_answers(spark, coerce):
    df = spark.createDataFrame([(i, a) for i, a in enumerate(ANSWERS)], "i int, a string")
    got = {r["i"]: r["x"] for r in df.select("i", T.parsed_breaks(F.col("a"), F.lit(50), coerce).alias("x")).collect()}
    assert got == {i: answer_model(a, coerce) for i, a in enumerate(ANSWERS)}
