"""The registered queries, each over its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import providers
from ..functions import text as T
from ..operators import ann, chunking, cutting, experiments, retrieval
from ..operators.index import KeptIndex
from ..sources import files
from ..sources.versions import Collection, Results
from ..sources.work import folder, materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


#: Files of up to so many bytes are dealt to all cores by their first column; larger ones come in splits of their own.
SMALL_BYTES = 32_000_000


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents for work that is heavy on the processor: a small file is one split, and would be one task."""
    df = _read(spark, sf_dir, "documents")
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())  # of the files, without reading them
    return df.repartition(spark.sparkContext.defaultParallelism, "doc_id") if size <= SMALL_BYTES else df


@query
def doc_load(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", F.length(T.trim(F.col("text"))).cast("long").alias("n_chars_trimmed")).where("n_chars_trimmed > 0")


@query
def tokens_df(spark, sf):
    postings = retrieval.term_frequencies(_documents(spark, sf), "doc_id")
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query
def sentences(spark, sf):
    df = _documents(spark, sf).select("doc_id", T.sentences(F.col("text")).alias("s"))
    longest = F.coalesce(F.array_max(F.transform("s", lambda x: F.length(x))), F.lit(0))
    return df.select("doc_id", F.size("s").cast("long").alias("n_sentences"), longest.cast("long").alias("max_len"))


@query
def chunks_fixed(spark, sf):
    return chunking.fixed(_documents(spark, sf)).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "text")


@query
def chunks_newline(spark, sf):
    return chunking.newline(_documents(spark, sf)).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.length("text").cast("long").alias("n_chars"))


@query
def chunks_agentic_fallback(spark, sf):
    out = chunking.planned(_documents(spark, sf))
    return out.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("n_sent").cast("long").alias("n_sent"), "text")


@query
def adjacent_similarity(spark, sf):
    return chunking.sentence_gaps(_read(spark, sf, "embeddings"), "label", "vec_id")


@query
def semantic_breakpoints(spark, sf):
    gaps = chunking.sentence_gaps(_read(spark, sf, "embeddings"), "label", "vec_id")
    cut = gaps.groupBy("label").agg(F.expr("percentile(sim, 0.7)").alias("threshold"))
    out = gaps.join(cut, "label").groupBy("label", "threshold").agg(F.count(F.when(F.col("sim") <= F.col("threshold"), 1)).alias("n_breaks"))
    return out.select("label", F.round("threshold", 6).alias("threshold"), "n_breaks")


@query
def chunks_semantic_ranges(spark, sf):
    out = chunking.semantic_ranges(_read(spark, sf, "embeddings"), "label", "vec_id")
    return out.select("label", *[F.col(c).cast("long").alias(c) for c in ("chunk_index", "first", "last")])


@query
def bm25_topk(spark, sf):
    return retrieval.bm25(_documents(spark, sf), _read(spark, sf, "benchmark"), ["doc_id"])


@query
def bm25_chunk_topk(spark, sf):
    return retrieval.bm25(chunking.fixed(_documents(spark, sf)), _read(spark, sf, "benchmark"), ["doc_id", "chunk_index"])


def _asked(vectors: DataFrame) -> DataFrame:
    """The query set of the searches: every row whose id is divisible by 100."""
    return vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


@query
def vector_topk_l2(spark, sf):
    v = _read(spark, sf, "embeddings")
    return retrieval.vectors(v, _asked(v), "l2")


@query
def vector_topk_cosine(spark, sf):
    v = _read(spark, sf, "embeddings")
    return retrieval.vectors(v, _asked(v), "cosine")


@query
def ann_topk(spark, sf):
    """The same by cells and product codes; near all of the exact neighbours, see ann_recall."""
    v = _read(spark, sf, "embeddings")
    return ann.search(ann.build(v, "cosine"), _asked(v))


@query
def ann_recall(spark, sf):
    """How many of the exact neighbours the approximate search finds."""
    v = _read(spark, sf, "embeddings")
    parts = [ann.recall(ann.search(ann.build(v, d), _asked(v)), retrieval.vectors(v, _asked(v), d)).withColumn("measure", F.lit(d)) for d in ("cosine", "l2")]
    return parts[0].unionByName(parts[1])


@query
def hyde_topk(spark, sf):
    """The passage's vector is stood in for by the mean vector of a label."""
    v = _read(spark, sf, "embeddings")
    means = v.select("label", F.posexplode("embedding").alias("at", "x")).groupBy("label", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    passages = means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("query_vector"))
    out = retrieval.vectors(v, passages.select((-F.col("label").cast("long") - 1).alias("query_id"), "query_vector"), "l2")
    return out.select((-F.col("query_id") - 1).cast("int").alias("label"), "rank", "vec_id", "distance")


@query
def hybrid_union(spark, sf):
    """What BM25 finds among the chunks, and then what vectors find, of one index."""
    items, key = _read(spark, sf, "benchmark"), ["doc_id", "chunk_index"]
    index = retrieval.lexical_index(chunking.fixed(_documents(spark, sf)), key)
    lists = {"bm25": retrieval.bm25(index, items, key), "vector": retrieval.text_vectors(index, items)}
    return retrieval.hybrid(lists, ["item_id", "rank", *key, "score"]).drop("method_order")


@query
def vector_chunk_topk(spark, sf):
    """Chunks whose hashed vectors are nearest to an item's."""
    index = retrieval.lexical_index(chunking.fixed(_documents(spark, sf)), ["doc_id", "chunk_index"])
    return retrieval.text_vectors(index, _read(spark, sf, "benchmark"))


def _hits(spark, sf, ranked: DataFrame, bodies: DataFrame, key: list[str]) -> DataFrame:
    """Every item's ranks, and whether the text there holds the item's text."""
    items = _read(spark, sf, "benchmark")
    hits = ranked.join(bodies, key).join(items.withColumnRenamed("text", "item"), "item_id").select("item_id", "rank", F.coalesce(F.contains("text", "item").cast("int"), F.lit(0)).alias("hit"))
    return items.select("item_id").join(hits, "item_id", "left")


@query
def retrieval_metrics(spark, sf):
    docs = _read(spark, sf, "documents").select("doc_id", "text")
    return retrieval.single_metrics(_hits(spark, sf, bm25_topk(spark, sf), docs, ["doc_id"]), "item_id")


#: Chunkings and retrieval methods of the experiments; every one of the nine pairs is a pipeline.
CHUNKINGS = {"fixed": cutting.fixed, "semantic": cutting.semantic, "agentic": cutting.agentic}
RETRIEVALS = {"traditional": "traditional-rag", "bm25": "bm25", "hyde": "hyde"}


def _indexes(docs: DataFrame, names: list[str]) -> dict:
    return {c: retrieval.lexical_index(docs, ["doc_id", "chunk_index"], CHUNKINGS[c]) for c in names}


def _pipeline_scores(spark, sf, pipelines: list[str], k: int = 5, indexes: dict | None = None) -> DataFrame:
    """pipeline, item_id and metrics of every item; a hit is a chunk of a document that has the item's text.

    indexes: those of the pipelines' chunkings, if they are there already.
    """
    docs, items = _documents(spark, sf).select("doc_id", "text"), _read(spark, sf, "benchmark")
    indexes = indexes or _indexes(docs, list(dict.fromkeys(p.split("+")[0] for p in pipelines)))
    rows = None
    for name in pipelines:
        chunks, method = name.split("+")
        found = retrieval.retrieve(RETRIEVALS[method], indexes[chunks], items).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", F.lit(name).alias("pipeline"))
        rows = found if rows is None else rows.unionByName(found)
    rows = materialize(rows, "ranked")  # k rows for each item and pipeline
    wanted = F.broadcast(rows.select("doc_id").distinct()) if rows.count() <= retrieval.BROADCAST_ROWS else rows.select("doc_id").distinct()
    hits = rows.join(docs.join(wanted, "doc_id", "left_semi"), "doc_id").join(items.withColumnRenamed("text", "item"), "item_id")
    hits = hits.select("pipeline", "item_id", "rank", F.coalesce(F.contains("text", "item").cast("int"), F.lit(0)).alias("hit"))
    names = spark.createDataFrame([(p,) for p in pipelines], "pipeline string")
    every = items.select("item_id").join(F.broadcast(names), F.lit(True)).join(hits, ["pipeline", "item_id"], "left")  # nine names at most
    return retrieval.single_metrics(every, ["pipeline", "item_id"], k)


METRICS = ["hit_rate", "mrr", "precision", "ndcg"]
NINE = [f"{c}+{m}" for c in CHUNKINGS for m in RETRIEVALS]


def _pipeline_means(scores: DataFrame) -> DataFrame:
    return scores.groupBy("pipeline").agg(*[F.round(F.avg(c), 4).alias(c) for c in METRICS])


@query
def pipeline_summary(spark, sf):
    """All pipelines over one index for each chunking."""
    return _pipeline_means(_pipeline_scores(spark, sf, NINE))


#: Pipelines that are run again, with fewer ranks.
RERUN, RERUN_RANKS = ["fixed+bm25", "fixed+hyde"], 3


@query
def pipeline_rerun(spark, sf):
    """Kept results of the pipelines over one chunking; two of them are run again and take the place of their old rows."""
    kept = Results(spark, f"{folder(spark)}/granary/results-{uuid.uuid4().hex}", "pipeline string, item_id long, hit_rate double, mrr double, precision double, ndcg double")
    three = [f"fixed+{m}" for m in RETRIEVALS]
    indexes = _indexes(_documents(spark, sf).select("doc_id", "text"), ["fixed"])  # both runs search the same chunks
    kept.replace(_pipeline_scores(spark, sf, three, indexes=indexes), three)
    kept.replace(_pipeline_scores(spark, sf, RERUN, RERUN_RANKS, indexes), RERUN)
    return _pipeline_means(kept.rows())


@query
def timed_jobs(spark, sf):
    """Two searches as jobs over two batches of items each, with an item's seconds; one more job always fails."""
    docs, items = _documents(spark, sf), _read(spark, sf, "benchmark")
    index = retrieval.lexical_index(docs, ["doc_id"])
    found = lambda search: lambda part: search(part).groupBy("item_id").agg(F.count("*").alias("found"))
    jobs = {"bm25": found(lambda part: retrieval.bm25(index, part, ["doc_id"])), "vector": found(lambda part: retrieval.text_vectors(index, part)), "broken": lambda part: part.select("item_id", "found")}
    kept = Results(spark, f"{folder(spark)}/granary/results-{uuid.uuid4().hex}", experiments.RESULT.format(metrics="found double"))
    experiments.run_jobs(kept, jobs, items, ["found"], batches=2)
    return experiments.job_summary(kept.rows(), ["found"])


@query
def search_rounds(spark, sf):
    """A search with feedback over the documents: what its rounds find."""
    docs = _documents(spark, sf)
    return experiments.search_rounds(retrieval.lexical_index(docs, ["doc_id"]), docs, _read(spark, sf, "benchmark"), rounds=2)


@query
def context_scores(spark, sf):
    """Scores of the best documents as contexts of an item, whose text is the reference; the answer is stood in for by the best context's first sentence."""
    docs, items = _read(spark, sf, "documents"), _read(spark, sf, "benchmark")
    found = retrieval.answers(bm25_topk(spark, sf), docs, items, ["doc_id"], lambda asked, contexts: F.get(T.sentences(F.get(contexts, F.lit(0))), F.lit(0)))
    rows = found.join(items.select("item_id", F.col("text").alias("reference")), "item_id").withColumnRenamed("retrieved_contexts", "contexts")
    return experiments.context_scores(rows, "item_id")


@query
def context_score_means(spark, sf):
    return retrieval.means(context_scores(spark, sf), ["context_precision", "context_recall", "faithfulness", "answer_relevancy"])


@query
def planner_answers(spark, sf):
    """Break positions of answers with mixed lists, built of events' columns, by both rules."""
    odd = F.when(F.col("user_id") % 4 == 0, F.concat(F.lit('"'), (F.col("event_id") % 9).cast("string"), F.lit('"'))).when(F.col("user_id") % 4 == 1, F.concat((F.col("event_id") % 9).cast("string"), F.lit(".5")))
    odd = F.when(odd.isNotNull(), odd).when(F.col("user_id") % 4 == 2, F.lit("null")).otherwise(F.lit("true"))
    answer = F.concat(F.lit('{"break_after": ['), (F.col("event_id") % 10).cast("string"), F.lit(", "), odd, F.lit(", "), (F.col("event_id") % 7 - 1).cast("string"), F.lit("]}"))
    fenced = F.when(F.col("event_type") == "click", F.concat(F.lit("```json\n"), answer, F.lit("\n```"))).otherwise(answer)
    breaks = lambda c: F.array_join(T.parsed_breaks(fenced, F.lit(8), coerce=c), ",")
    return _read(spark, sf, "events").select("event_id", breaks(False).alias("breaks"), breaks(True).alias("coerced"))


@query
def collection_growth(spark, sf):
    """Documents added in two overlapping parts, one of them twice: rows by source, and what a counting tool answers."""
    docs = _read(spark, sf, "documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    kept = Collection(spark, f"{folder(spark)}/granary/kept-{uuid.uuid4().hex}", "doc_id long, source string, digest string")
    low, high = docs.where("doc_id % 3 < 2"), docs.where("doc_id % 3 > 0")
    for part in (low, high, high):
        kept.add(part)
    rows = kept.rows().groupBy("source").agg(F.count("*").alias("n_rows"), F.max("doc_id").alias("last"))
    return rows.withColumn("report", retrieval.count_report(F.lit(kept.count())))


@query
def index_growth(spark, sf):
    """BM25 over an index that grew by two batches, the second of which came twice, and was compacted."""
    docs, items = _documents(spark, sf).select("doc_id", "text"), _read(spark, sf, "benchmark")
    kept = KeptIndex(spark, f"{folder(spark)}/granary/index-{uuid.uuid4().hex}", "doc_id long, text string", ["doc_id"])
    for batch in (0, 1, 1):
        kept.add(docs.where(F.col("doc_id") % 2 == batch), batch=str(batch))
    kept.compact()
    return retrieval.bm25(kept.open(), items, ["doc_id"])


@query
def retrieval_metrics_multi(spark, sf):
    v = _read(spark, sf, "embeddings")
    labels = v.select("vec_id", "label")
    ranked = vector_topk_cosine(spark, sf).join(labels, "vec_id").withColumnRenamed("label", "found")
    truth = labels.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    sizes = labels.groupBy("label").agg((F.count("*") - 1).alias("n_relevant"))
    hits = ranked.join(truth, "query_id").select("query_id", "rank", (F.col("found") == F.col("label")).cast("int").alias("hit"))
    return retrieval.multi_metrics(hits, truth.join(sizes, "label").select("query_id", "n_relevant"), "query_id")


@query
def source_matching(spark, sf):
    names = _read(spark, sf, "part").select(F.col("p_name").alias("name"))
    return retrieval.match_names(names, _read(spark, sf, "part").select(F.concat(F.col("p_brand"), F.lit(" "), F.col("p_type")).alias("file")))


@query
def url_filename(spark, sf):
    links = _read(spark, sf, "pages").select("url").where("url is not null").distinct()
    return links.select("url", T.safe_file_name(F.col("url")).alias("file_name"))


@query
def dedupe_first(spark, sf):
    docs = _read(spark, sf, "documents").select(F.sha2("text", 256).alias("digest"), "doc_id", "source")
    return retrieval.first_of(docs, ["digest"], ["doc_id"])


@query
def last_message(spark, sf):
    return _read(spark, sf, "conversations").groupBy("conv_id").agg(T.message_text(F.max_by("text", "turn")).alias("text"))


@query
def context_blocks(spark, sf):
    turns = _read(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    texts = F.transform("t", lambda x: x["text"])
    return turns.select("conv_id", T.context_block(texts).alias("context"), T.judge_context(texts).alias("judge_context"))


@query
def previews(spark, sf):
    text = F.col("text")
    return _documents(spark, sf).select("doc_id", T.preview(text).alias("preview"), T.hard_cut(text).alias("cut"), T.prompt_sentence(text).alias("for_prompt"), F.sha2(T.sanitize(text), 256).alias("clean_sha256"))


@query
def name_tokens(spark, sf):
    return _read(spark, sf, "part").select("p_partkey", T.normal_name(F.col("p_type")).alias("normal"), F.array_join(F.array_sort(T.name_tokens(F.concat_ws(" ", "p_type", "p_name"))), " ").alias("tokens"))


@query
def judge_summary(spark, sf):
    rows = _read(spark, sf, "documents").join(_read(spark, sf, "labels"), "doc_id", "left").where("coalesce(lang, '') <> '' and coalesce(source, '') <> ''")
    clean = 1 - F.col("toxic")
    passed = ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")
    out = retrieval.summary(rows, ["lang", "source"], {"avg_quality": F.col("quality"), "avg_clean": clean, "avg_pass": passed})
    return out.withColumn("label", F.concat_ws("+", "lang", "source"))


@query
def judge_rank(spark, sf):
    out = judge_summary(spark, sf)
    order = Window.partitionBy("lang").orderBy(F.desc("avg_pass"), "label")
    return out.select("lang", "label", "avg_pass", F.row_number().over(order).alias("place"))


@query
def sample_rows(spark, sf):
    """A seeded sample of 50 documents without replacement, sorted by id."""
    order = F.pmod(F.col("doc_id") * 48271 + 42, F.lit(2147483647))
    return files.sample(_read(spark, sf, "documents").select("doc_id"), "doc_id", 50, order=order)


@query
def json_breaks(spark, sf):
    """Break positions of a planner's answer, here built from the digits of an event's id, in a code fence."""
    answer = F.concat(F.lit('```json\n{"break_after": ['), F.concat_ws(", ", F.col("event_id") % 10, F.col("event_id") % 7 - 1), F.lit("]}\n```"))
    return _read(spark, sf, "events").select("event_id", F.array_join(T.parsed_breaks(answer, F.lit(8)), ",").alias("breaks"))


@query
def unique_sources(spark, sf):
    ranked = bm25_topk(spark, sf).join(_read(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return ranked.groupBy("item_id").agg(F.countDistinct("source").alias("n_sources"))


@query
def chunks_agentic_eval(spark, sf):
    """The planner is stood in for by word overlap of neighbouring sentences."""
    out = chunking.agentic_eval(_documents(spark, sf), providers.overlap_planner)
    return out.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "text")


@query
def chunks_semantic(spark, sf):
    """Likeness of sentences is that of their sets of tokens, which SQL can also tell."""
    out = chunking.semantic(_documents(spark, sf), T.tokens, T.jaccard)
    return out.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "text")


@query
def bm25_padded(spark, sf):
    docs = _documents(spark, sf)
    return retrieval.bm25(docs, _read(spark, sf, "benchmark"), ["doc_id"], pad=True)


@query
def agentic_retrieval(spark, sf):
    """The agent is stood in for by two calls: one asks for the first half of an item's tokens, one for the second."""
    return retrieval.retrieve("agentic-rag", retrieval.lexical_index(_documents(spark, sf), ["doc_id"]), _read(spark, sf, "benchmark"))


@query
def grounded_answers(spark, sf):
    """Answers over the best documents; the answering model is stood in for by question and contexts."""
    docs, items = _read(spark, sf, "documents"), _read(spark, sf, "benchmark")
    out = retrieval.answers(bm25_topk(spark, sf), docs, items, ["doc_id"], providers.answer)
    return out.select("item_id", F.sha2("answer", 256).alias("answer_sha256"), F.size("retrieved_contexts").cast("long").alias("n_contexts"), F.array_join("retrieved_sources", ",").alias("sources"))


@query
def search_reports(spark, sf):
    docs = _documents(spark, sf)
    best = materialize(bm25_chunk_topk(spark, sf), "ranked")
    found = docs.join(F.broadcast(best.select("doc_id").distinct()), "doc_id", "left_semi") if best.count() <= retrieval.BROADCAST_ROWS else docs
    hits = best.join(chunking.fixed(found), ["doc_id", "chunk_index"]).join(found.select("doc_id", "source"), "doc_id")
    hits = hits.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "source", F.col("chunk_index").alias("chunk"), "text"))).alias("hits"))
    return hits.select("item_id", T.search_report("BM25", F.col("hits")).alias("report"))


@query
def usable_questions(spark, sf):
    """Conversations as question rows: first and last turn, with the roles of their turns as evidence."""
    turns = _read(spark, sf, "conversations")
    named = F.struct(F.when(F.col("role") == "user", F.lit("")).otherwise(F.col("role")).alias("doc_name"), F.concat("role", F.lit("_"), (F.col("turn") % 3).cast("string")).alias("evidence_doc_name"))
    rows = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"), F.max_by("text", "turn").alias("answer"), F.collect_list(named).alias("evidence"))
    out = files.usable_questions(rows.withColumn("dataset_subset_label", F.lit("OPEN_SOURCE")))
    return out.select("conv_id", "question", "answer", F.array_join("evidence_doc_names", ",").alias("evidence_doc_names"))


@query
def eval_examples(spark, sf):
    items = _read(spark, sf, "benchmark").select(F.col("text").alias("query"), F.col("item_id").cast("string").alias("reference_answer"), F.lit(None).cast("string").alias("source"))
    return files.eval_examples(items).select("inputs.query", "outputs.reference_answer", "metadata.source")


@query
def judge_metrics(spark, sf):
    """Labels as a judge's list of metrics, back as columns, with the verdict of all of them."""
    entry = lambda k, s, v: F.struct(F.lit(k).alias("key"), s.cast("double").alias("score"), v.cast("double").alias("value"))
    labels = _read(spark, sf, "labels")
    got = labels.select("doc_id", retrieval.metric_map(F.array(entry("good", F.col("quality"), F.lit(-1)), entry("clean", F.lit(None), 1 - F.col("toxic")))).alias("m"))
    return got.select("doc_id", F.col("m.good").alias("good"), F.col("m.clean").alias("clean"), retrieval.judge_pass(F.col("m.good"), F.col("m.clean")).alias("passed"))


@query
def score_means(spark, sf):
    rows = _read(spark, sf, "documents").join(_read(spark, sf, "labels"), "doc_id", "left")
    return retrieval.means(rows, ["quality", "toxic", "faithfulness"], ["lang"])


@query
def question_prompts(spark, sf):
    """Prompts for writing questions about every document of 200 characters or more."""
    template = "Document ({name}):\n{text}\n\nWrite 2 questions that only this document answers."
    docs = _read(spark, sf, "documents").where(F.length("text") >= 200)
    return docs.select("doc_id", F.sha2(T.prompt(template, name=F.col("source"), text=F.substring("text", 1, 4000)), 256).alias("prompt_sha256"))
