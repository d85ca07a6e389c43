import pytest
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import chunking, retrieval
from granary.plans import catalogue, oracles
from granary.sources import files
from tests.oracle_check import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_equals_sql(spark, name):
    assert compare(spark, SF, name, catalogue.QUERIES[name], oracles.SQL[name]) == ""


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, T.tokens(F.lit("Café ROI über_x a1 don't 10% ünï 5th"))) == ["roi", "a1", "don", "t", "10", "5th"]
    assert one(spark, T.tokens(F.lit("m² x"))) == ["x"]


def test_sentences(spark):
    assert one(spark, T.sentences(F.lit("A.\u00a0B. C!  D?\nE"))) == ["A.", "B.", "C!", "D?", "E"]


@pytest.mark.parametrize(("n", "ends"), [(1000, [1000]), (1001, [1000, 201]), (2500, [1000, 1000, 900])])
def test_fixed_windows(spark, n, ends):
    docs = spark.createDataFrame([(1, "x" * n)], "doc_id long, text string")
    assert [len(r["text"]) for r in chunking.fixed(docs).orderBy("chunk_index").collect()] == ends


def test_fold(spark):
    ranges = one(spark, chunking.fold_ranges(F.lit(4), F.array(F.lit(0), F.lit(2)), 8, 2, 2))
    assert [(r["begin"], r["end"]) for r in ranges] == [(0, 2), (1, 3)]


def test_breaks(spark):
    for n, want in ((6, []), (7, [5]), (12, [5]), (20, [5, 11, 17])):
        assert one(spark, chunking.fallback_breaks(F.lit(n))) == want
    assert one(spark, chunking.normal_breaks(F.array(*map(F.lit, [3, -1, 3, 9, 0])), F.lit(10))) == [0, 3]
    assert one(spark, chunking.enforced_breaks(F.array(*map(F.lit, [0, 1, 2, 9])), F.lit(12))) == [1, 7, 9]


def test_newline_merge(spark):
    def model(text, size, overlap):
        out, held, total = [], [], 0
        for line in (x for x in text.split("\n") if x):
            if held and total + len(line) + 1 > size:
                out.append("\n".join(held))
                while held and (total > overlap or total + len(line) + 1 > size):
                    total -= len(held[0]) + (len(held) > 1)
                    held = held[1:]
            held.append(line)
            total += len(line) + (len(held) > 1)
        return [x.strip() for x in [*out, "\n".join(held)] if x.strip()]

    text = "\n".join("abcdefghij"[: 1 + i * 7 % 10] * (1 + i % 3) for i in range(60))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [r["text"] for r in chunking.newline(docs, 50, 15).orderBy("chunk_index").collect()]
    assert got == model(text, 50, 15)


def test_metrics(spark):
    hits = spark.createDataFrame([(1, 1, 1), (1, 2, 0), (1, 3, 1), (1, 4, 0), (1, 5, 1), (2, None, None)], "q int, rank int, hit int")
    rows = {r["q"]: r for r in retrieval.single_metrics(hits, "q").collect()}
    assert (rows[1]["hit_rate"], rows[1]["mrr"], rows[1]["precision"], rows[1]["ndcg"]) == (1.0, 1.0, 0.6, 1.886853)
    assert rows[2]["hit_rate"] == rows[2]["ndcg"] == 0.0
    ranked = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 3, 1)], "q int, rank int, hit int")
    r = retrieval.multi_metrics(ranked, spark.createDataFrame([(1, 2)], "q int, n_relevant int"), "q").first()
    assert (r["precision"], r["recall"], r["mrr"], r["ndcg"]) == (0.4, 1.0, 0.5, 0.693426)


def test_name_matching(spark):
    names = spark.createDataFrame([("PEPSICO_2022_10K",), ("zzz",)], "name string")
    files = spark.createDataFrame([("x_PepsiCo_2022_10K",), ("other",)], "file string")
    rows = {r["name"]: r for r in retrieval.match_names(names, files).collect()}
    assert rows["PEPSICO_2022_10K"]["files"] == "x_PepsiCo_2022_10K" and rows["zzz"]["match_class"] == "unmatched"


def test_stream(spark, tmp_path):
    from granary.streaming.ingest import index_stream

    spark.createDataFrame([(1, "one two"), (2, "two three")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    index_stream(spark, str(tmp_path / "in"), "doc_id long, text string", str(tmp_path / "out"), str(tmp_path / "at")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/chunks")).count() == 2


def test_long_runs_are_capped(spark):
    breaks = one(spark, chunking.enforced_breaks(F.array(F.lit(997)), F.lit(1000)))
    ends = [-1, *breaks, 999]
    assert max(b - a for a, b in zip(ends, ends[1:])) <= 6 and 997 in breaks


def test_planner_windows(spark):
    sentences = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda i: i.cast("string"))
    sizes = lambda s: F.array(F.size(s) - 1)
    assert one(spark, chunking.window_breaks(sentences, sizes)) == [79, 99]
    assert one(spark, chunking.window_breaks(F.slice(sentences, 1, 80), sizes)) == [79]
    assert one(spark, chunking.window_breaks(F.slice(sentences, 1, 80), sizes, to_end=True)) == [79]
    assert one(spark, chunking.window_breaks(sentences, lambda s: F.array(F.lit(-1), F.lit(80), F.lit(3)))) == [3, 73]


def test_whole_texts_stay(spark):
    docs = spark.createDataFrame([(1, " One. Two. "), (2, None), (3, ""), (4, "A a. B b. C c.")], "doc_id long, text string")
    none = lambda s: F.array().cast("array<int>")
    got = {(r["doc_id"], r["chunk_index"]): r["text"] for r in chunking.agentic_eval(docs, none).collect()}
    assert got == {(1, 0): " One. Two. ", (3, 0): "", (4, 0): "A a. B b. C c."}
    got = {(r["doc_id"], r["chunk_index"]): r["text"] for r in chunking.semantic(docs, T.tokens, T.jaccard).collect()}
    assert got == {(1, 0): "One. Two.", (3, 0): "", (4, 0): "A a. B b.", (4, 1): "A a. B b. C c."}  # both sentences before are carried


def test_percentile(spark):
    values = F.array(*map(F.lit, [0.1, 0.5, 0.2, 0.9, 0.7]))
    assert one(spark, T.array_percentile(values, 0.7)) == pytest.approx(0.66)
    assert one(spark, T.array_percentile(F.array().cast("array<double>"), 0.7)) == 0.0


@pytest.mark.parametrize(("url", "tail"), [("https://h.com/a/b%20c.PDF?x=1", "b_c.PDF"), ("https://h.com/a.pdf.html", None), ("https://h.com/d/e.pdf/", "e.pdf"), ("https://h.com/f.pdf;v=1", "f.pdf"), ("https://h.com", None), ("https://h.com/%zz.pdf", "_zz.pdf")])
def test_file_names(spark, url, tail):
    import hashlib

    digest = hashlib.sha256(url.encode()).hexdigest()[:12]
    assert one(spark, T.safe_file_name(F.lit(url))) == f"{digest}_{tail or digest + '.pdf'}"


def test_messages(spark):
    assert one(spark, T.message_text(F.lit('["a", {"type": "text", "text": "b"}]'))) == "a\nb"
    assert one(spark, T.message_text(F.lit("[not a list"))) == "[not a list"


def test_padding(spark):
    docs = spark.createDataFrame([(i, "word" if i == 3 else "other thing" if i % 2 else None) for i in range(9)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "word"), (2, "unknown"), (3, None)], "item_id long, text string")
    got: dict = {}
    for r in retrieval.bm25(docs, asked, ["doc_id"], pad=docs).orderBy("item_id", "rank").collect():
        got.setdefault(r["item_id"], []).append(r["doc_id"])
    assert got == {1: [3, 0, 1, 2, 4], 2: [0, 1, 2, 3, 4], 3: [0, 1, 2, 3, 4]}


def test_agent(spark):
    calls = spark.createDataFrame([(1, 1, 1, 7), (1, 1, 2, 8), (1, 2, 1, 8), (1, 2, 2, 9)], "item_id long, call int, rank int, doc_id long")
    fallback = spark.createDataFrame([(1, 1, 5), (2, 1, 6)], "item_id long, rank int, doc_id long")
    rows = retrieval.agentic(calls, fallback, "item_id", ["doc_id"]).orderBy("item_id", "place").collect()
    assert [(r["item_id"], r["place"], r["doc_id"]) for r in rows] == [(1, 1, 7), (1, 2, 8), (1, 3, 9), (2, 1, 6)]
    with pytest.raises(ValueError):
        retrieval.retrieve("magic")


def test_judges(spark):
    entry = "array<struct<key:string,score:double,value:double>>"
    df = spark.createDataFrame([([("a", 1.0, None), ("b", None, 2.0), ("a", 0.0, 5.0)],), ([],)], f"e {entry}")
    assert [r["m"] for r in df.select(retrieval.metric_map(F.col("e")).alias("m")).collect()] == [{"a": 0.0, "b": 2.0}, {}]
    assert one(spark, retrieval.judge_pass(F.lit(1), F.lit(None))) == 0
    scores = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (2.0,)], "x double")
    assert retrieval.means(scores, ["x", "gone"]).first().asDict() == {"x": 1.5}


def test_questions(spark):
    columns = "id string, question string, answer string, dataset_subset_label string, evidence array<struct<doc_name:string,evidence_doc_name:string>>"
    rows = [("1", " q ", "a", None, [("", "z"), ("y", "x"), (None, None)]), ("2", "q", " ", None, None), ("3", "q", "a", "CLOSED", None), (None, "q", "a", "OPEN_SOURCE", None)]
    got = files.usable_questions(spark.createDataFrame(rows, columns)).orderBy("id").collect()
    assert [(r["id"], r["question"], r["evidence_doc_names"]) for r in got] == [("", "q", []), ("1", "q", ["y", "z"])]
    few = spark.range(5)
    assert files.sample(few, "id", 3).count() == 3
    with pytest.raises(ValueError):
        files.sample(few, "id", 6)


def test_chunk_rows(spark):
    data = [("a", "0", "x"), ("a", None, "q"), ("a", "zz", "p"), (None, None, "y"), ("a", "1", " "), ("a", "4", None)]
    df = spark.createDataFrame(data, "source string, chunk_index string, text string").repartition(5)
    got = sorted((r["source"], r["chunk_index"], r["text"], r["chunk_method"]) for r in files.chunk_rows(df, "fixed").collect())
    assert got == [("a", 0, "x", "fixed"), ("a", 1, "p", "fixed"), ("a", 2, "q", "fixed"), ("unknown", 0, "y", "fixed")]


def test_kept_tables_grow(spark, tmp_path):
    path = str(tmp_path / "kept")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, text string")
    assert files.count_rows(spark, path) == 0
    assert files.keep(df.limit(0), path).count() == 0 and files.keep(df, path).count() == 2  # an empty table is built again
    assert files.add_rows(df, path) == 4 and files.keep(df.limit(1), path).count() == 4
    assert files.keep(df.limit(1), path, rebuild=True).count() == 1


def test_files_round_trip(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    for name, text in (("a.md", " # one \n"), ("b.md", "two"), ("c.md", "  "), ("d.txt", "no")):
        (folder / name).write_text(text)
    got = {r["source"]: r["text"] for r in files.markdown(spark, str(folder)).collect()}
    assert got == {"a.md": "# one", "b.md": "two"}
    (tmp_path / "set.json").write_text('[{"query": "q1", "reference_answer": "r", "source": "a.md"}, {"query": ""}]')
    assert [tuple(r) for r in files.test_set(spark, str(tmp_path / "set.json")).collect()] == [("q1", "r", "a.md")]
    scores = spark.createDataFrame([("b", 0.5, None), ("a", 1 / 3, 2.0)], "pipeline string, mrr double, ndcg double")
    files.write_results(scores, str(tmp_path / "out"), "pipeline", ["mrr", "ndcg"])
    lines = [x for f in sorted((tmp_path / "out").glob("*.csv")) for x in f.read_text().splitlines()]
    assert lines == ["pipeline,mrr,ndcg", "a,0.333333,2.000000", "b,0.500000,0.000000"]
    files.write_rows(scores, str(tmp_path / "rows"))
    assert {tuple(r) for r in spark.read.schema(scores.schema).json(str(tmp_path / "rows.json")).collect()} == {tuple(r) for r in scores.collect()}
    merged = files.merge_results(scores, spark.createDataFrame([("a", 0.9), ("c", 0.1)], "pipeline string, mrr double"), "pipeline")
    assert sorted(map(tuple, merged.collect())) == [("a", 0.9, 2.0), ("b", 0.5, None), ("c", 0.1, None)]
    assert [r["pipeline"] for r in files.sorted_results(scores, "ndcg", "pipeline").collect()] == ["b", "a"]
    assert [files.setting("k", g, e, 5) for g, e in (({"k": 1}, {"k": 2}), ({"k": ""}, {"k": 2}), ({}, {}))] == [1, 2, 5]


def test_trim_and_tokens_of_odd_texts(spark):
    texts = ["  a b \u00a0", "\u2003x\n", "", "a" + " " * 20_000 + "b", "a_b c1 _d e", "Café ROI über_x 5th", "\u212a1 k", "9a_ 9b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = [tuple(r) for r in df.orderBy("id").select(T.trim(F.col("text")), T.tokens(F.col("text"))).collect()]
    import regex

    for t, (trimmed, tokens) in zip(texts, got, strict=True):
        assert trimmed == t.strip()
        assert tokens == regex.findall(r"(?<![\p{L}\p{N}_])[a-z0-9]++(?![\p{L}\p{N}_])", t.lower())


def test_vectors_in_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8)).round(2)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(99, None)], "vec_id long, embedding array<float>").repartition(3)
    asked = df.where("vec_id < 20").selectExpr("vec_id as query_id", "embedding as query_vector")
    want = {}
    for q in range(20):
        d = np.round(((x.astype(np.float32).astype(float) - x[q].astype(np.float32).astype(float)) ** 2).sum(axis=1), 6)
        want[q] = [i for i in np.lexsort((np.arange(60), d)).tolist() if i != q][:5]
    for cells in (4_000_000, 40):
        monkeypatch.setattr(retrieval, "MATRIX_CELLS", cells)
        rows = retrieval.vectors(df, asked, "l2").collect()
        assert {q: [r["vec_id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == q] for q in range(20)} == want
