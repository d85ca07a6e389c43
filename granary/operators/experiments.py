"""Runs of experiments: feedback rounds of a search, scores of contexts, timed jobs, and reruns of some pipelines."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.versions import Results
from ..sources.work import materialize
from .index import Index
from .retrieval import bm25_terms, query_terms, summary

#: Terms that a round of feedback adds to a query, and rounds at most.
FEEDBACK_TERMS, ROUNDS = 5, 4
#: A context counts as relevant from this share of the reference's words on.
RELEVANT = 0.5


def feedback_terms(hits: DataFrame, docs: DataFrame, index: Index, query: str, n: int) -> DataFrame:
    """query and term of the n terms of its hits with the greatest sum of count times idf, ties by term. hits: query, key."""
    rows = docs.join(hits.select(query, *index.key), index.key)
    each = rows.select(query, F.explode(T.tokens(F.coalesce("text", F.lit("")))).alias("term")).groupBy(query, "term").agg(F.count("*").alias("n"))
    weighed = each.join(index.statistics, "term").select(query, "term", F.round(F.col("n") * F.col("idf"), 6).alias("weight"))
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("weight"), "term"))
    return weighed.withColumn("place", place).where(F.col("place") <= n).select(query, "term")


def search_rounds(index: Index, docs: DataFrame, queries: DataFrame, query: str = "item_id", k: int = 5, rounds: int = ROUNDS) -> DataFrame:
    """round, rank, key and score of every row that a search with feedback finds first in that round.

    After each round a query's terms are its own and those of all rows found so far that weigh most (FEEDBACK_TERMS); a query
    whose round brought no new row stops, and when all have, the search ends. The state is a table a round.
    """
    own = query_terms(queries, query)
    terms, found, n = own, None, 1
    while n <= rounds:
        ranked = bm25_terms(index, terms, query, k).withColumn("round", F.lit(n))
        new = ranked if found is None else ranked.join(found.select(query, *index.key), [query, *index.key], "left_anti")
        new = materialize(new.select(query, "round", "rank", *index.key, "score"), "round")
        found = new if found is None else found.unionByName(new)
        if n == rounds or new.isEmpty():
            break
        going = new.select(query).distinct()
        more = feedback_terms(found.join(going, query, "left_semi"), docs, index, query, FEEDBACK_TERMS).withColumn("qtf", F.lit(1).cast("long"))
        terms = own.join(going, query, "left_semi").unionByName(more).groupBy(query, "term").agg(F.sum("qtf").alias("qtf"))
        n += 1
    return found


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence of two word lists: a row of the table is the bits of one number."""
    at: dict[str, int] = {}
    for i, word in enumerate(a):
        at[word] = at.get(word, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for word in b:
        both = row & at.get(word, 0)
        row = (row + both | row - both) & full
    return len(a) - row.bit_count()


def context_scores(rows: DataFrame, key: str) -> DataFrame:
    """key, context_precision, context_recall and faithfulness. rows: key, reference and answer, and contexts in order of rank.

    Words are tokens. A context's worth is the share of the reference's words that it has in order, as a longest common
    subsequence; recall is the best worth. Precision is the mean, over contexts of a worth of RELEVANT or more, of the share of
    such contexts up to theirs. Faithfulness is the best share of the answer's words that a context has in order. Without
    contexts, or without words to look for, a score is 0.
    """
    words = rows.select(key, *[T.tokens(F.coalesce(c, F.lit(""))).alias(c) for c in ("reference", "answer")], F.transform("contexts", lambda c: T.tokens(F.coalesce(c, F.lit("")))).alias("contexts"))
    kind = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "bigint": pa.int64()}[dict(rows.dtypes)[key]]

    def share(wanted: list[str], context: list[str]) -> float:
        return common_subsequence(wanted, context) / len(wanted) if wanted else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                contexts = row["contexts"] or []
                worth = [share(row["reference"], c) for c in contexts]
                good = [i for i, w in enumerate(worth) if w >= RELEVANT]
                precision = sum((n + 1) / (i + 1) for n, i in enumerate(good)) / len(good) if good else 0.0
                faithful = max((share(row["answer"], c) for c in contexts), default=0.0)
                out.append((row[key], round(precision, 6), round(max(worth, default=0.0), 6), round(faithful, 6)))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.float64()) for c in columns[1:])], [key, "context_precision", "context_recall", "faithfulness"])

    return words.mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, context_precision double, context_recall double, faithfulness double")


RESULT = "pipeline string, item_id long, {metrics}, latency_seconds double, error string"


def run_jobs(kept: Results, jobs: dict[str, Callable[[DataFrame], DataFrame]], items: DataFrame, metrics: list[str], batches: int = 1, query: str = "item_id") -> None:
    """Runs every pipeline on every batch of items and keeps its rows, with the seconds that an item took, in one commit.

    jobs: functions of items that give query and metrics. A job that fails gives a row for each of its items, without metrics
    and latency, with the error; other jobs go on. Rows of pipelines that aren't run stay as they were.
    """
    spark = items.sparkSession
    out = None
    for name, job in jobs.items():
        for b in range(batches):
            part = items.where(F.pmod(F.xxhash64(query), F.lit(batches)) == b)
            began = time.monotonic()
            try:
                rows = materialize(job(part).select(query, *[F.col(m).cast("double").alias(m) for m in metrics]), "job")
                n = rows.count()
                took = round((time.monotonic() - began) / max(n, 1), 6)
                rows = rows.withColumns({"latency_seconds": F.lit(took), "error": F.lit(None).cast("string")})
            except Exception as e:  # a failed job is a result
                error = str(e).splitlines()[0][:500] if str(e) else type(e).__name__
                rows = part.select(query, *[F.lit(None).cast("double").alias(m) for m in [*metrics, "latency_seconds"]], F.lit(error).alias("error"))
            rows = rows.select(F.lit(name).alias("pipeline"), query, *metrics, "latency_seconds", "error")
            out = rows if out is None else out.unionByName(rows)
    if out is not None:
        schema = kept.versions.spark.createDataFrame([], kept.schema).schema
        kept.replace(spark.createDataFrame([], schema).unionByName(out), list(jobs))


def job_summary(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """rows, failed and means of each pipeline; what failed counts as 0."""
    means = summary(rows, ["pipeline"], {f"avg_{m}": F.col(m) for m in [*metrics, "latency_seconds"]})
    return means.join(rows.groupBy("pipeline").agg(F.count("error").alias("failed")), "pipeline")
