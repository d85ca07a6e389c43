"""Lexical and vector retrieval, rank lists, and their metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions import providers
from ..functions import text as T
from ..sources.work import materialize
from .index import FILE_OPTIONS, Cosine, Index, Okapi, best_rows, lexical_index, query_blocks

#: Rows that are broadcast, at most; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Numbers of query vectors that go to every task at once, and rows that a task compares with them at once.
MATRIX_CELLS, ROWS_AT_ONCE = 4_000_000, 4_096


def term_frequencies(docs: DataFrame, *key: str) -> DataFrame:
    """key, length, term, tf of every term of every row of docs."""
    bags = docs.select(*key, T.tokens(F.coalesce("text", F.lit(""))).alias("bag"))
    each = bags.select(*key, F.size("bag").alias("length"), F.explode("bag").alias("term"))
    return each.groupBy(*key, "length", "term").agg(F.count("*").alias("tf"))


def top_k(scored: DataFrame, query: str, order: list[Column], k: int) -> DataFrame:
    """rank 1 to k of each query; the limit applies before the shuffle."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order))).where(F.col("rank") <= max(1, k))


def query_terms(queries: DataFrame, query: str) -> DataFrame:
    return queries.select(query, F.explode(T.tokens(F.coalesce("text", F.lit("")))).alias("term")).groupBy(query, "term").agg(F.count("*").alias("qtf"))


def bm25(docs: DataFrame | Index, queries: DataFrame, key: list[str], query: str = "item_id", k: int = 5, pad: bool | DataFrame = False) -> DataFrame:
    """The k best rows of docs, or of their index, for every query, by Okapi BM25.

    Rows that share no term with a query are no matches; with pad (true, or the rows of docs) they have score 0 and fill up the
    k, in order of the key.
    """
    pad = isinstance(pad, DataFrame) or pad
    index = docs if isinstance(docs, Index) else lexical_index(docs, key)
    return bm25_terms(index, query_terms(queries, query), query, k, pad, queries)


def bm25_terms(index: Index, terms: DataFrame, query: str, k: int = 5, pad: bool = False, queries: DataFrame | None = None) -> DataFrame:
    """The same for queries given as query, term and qtf; queries: all of them, if some have no term."""
    asked = terms.join(index.statistics, "term")
    asked = asked.select(query, "term", F.col("qtf").alias("count"), (F.col("qtf") * F.col("idf")).alias("weight"))
    scored = best_rows(index, query_blocks(asked, terms if queries is None else queries, query), Okapi(index.mean_length), query, k, pad)
    return top_k(scored, query, [F.desc("score"), *map(F.asc, index.key)], k).select(query, "rank", *index.key, "score")


def agentic(searches: DataFrame, fallback: DataFrame, query: str, key: list[str]) -> DataFrame:
    """What an agent found in all its calls (query, call, rank, key), each row once where it came first.

    Queries whose calls found nothing get the fallback's rows (query, rank, key).
    """
    found = first_of(searches.select(query, "call", "rank", *key), [query, *key], ["call", "rank"])
    rest = fallback.join(searches.select(query).distinct(), query, "left_anti").withColumn("call", F.lit(0))
    both = found.unionByName(rest.select(*found.columns))
    place = F.row_number().over(Window.partitionBy(query).orderBy("call", "rank", *key))
    return both.select(query, place.alias("place"), "call", *key)


def answers(ranked: DataFrame, bodies: DataFrame, queries: DataFrame, key: list[str], answer, query: str = "item_id") -> DataFrame:
    """answer, retrieved_contexts and retrieved_sources of every query. bodies: key, source, text; answer: (text, contexts) -> Column."""
    hits = ranked.join(bodies.select(*key, F.coalesce("source", F.lit("")).alias("source"), "text"), key)
    hits = hits.groupBy(query).agg(F.sort_array(F.collect_list(F.struct("rank", "source", "text"))).alias("hits"))  # k entries at most
    out = queries.select(query, F.col("text").alias("_asked")).join(hits, query, "left")
    none = F.array().cast("array<string>")
    out = out.withColumn("retrieved_contexts", F.coalesce(F.transform("hits", lambda h: h["text"]), none))
    out = out.withColumn("retrieved_sources", F.coalesce(F.transform("hits", lambda h: h["source"]), none))
    return out.select(query, answer(F.col("_asked"), F.col("retrieved_contexts")).alias("answer"), "retrieved_contexts", "retrieved_sources")


def half_queries(queries: DataFrame, query: str = "item_id") -> list[DataFrame]:
    """Stand-ins for an agent's calls: one asks for the first half of a query's tokens, one for the second."""
    bag = queries.select(query, T.tokens(F.coalesce("text", F.lit(""))).alias("bag")).withColumn("half", F.floor(F.size("bag") / 2).cast("int"))
    parts = F.slice("bag", F.lit(1), F.col("half")), F.slice("bag", F.col("half") + 1, F.size("bag"))
    return [bag.select(query, F.array_join(p, " ").alias("text")) for p in parts]


def agentic_search(index: Index, queries: DataFrame, query: str = "item_id", k: int = 5, calls=half_queries) -> DataFrame:
    """What an agent's calls find by BM25, and the nearest vectors for queries whose calls find nothing."""
    found = None
    for n, asked in enumerate(calls(queries, query)):
        got = bm25(index, asked, index.key, query, k).withColumn("call", F.lit(n + 1))
        found = got if found is None else found.unionByName(got)
    return agentic(found, text_vectors(index, queries, query, k), query, index.key)


def retrieve(method: str, index: Index | None = None, queries: DataFrame | None = None, query: str = "item_id", k: int = 5) -> DataFrame:
    """What the method of this name finds in an index; an unknown one raises."""
    methods = {"bm25": lambda: bm25(index, queries, index.key, query, k), "traditional-rag": lambda: text_vectors(index, queries, query, k), "hyde": lambda: hyde(index, queries, query, k), "agentic-rag": lambda: agentic_search(index, queries, query, k)}
    if method not in methods:
        raise ValueError(f"unknown method {method}; there are {', '.join(sorted(methods))}")
    return methods[method]()


def vectors(corpus: DataFrame, queries: DataFrame, distance: str, k: int = 5, key: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """The k nearest rows (key, embedding) for every query (query_id, query_vector), exactly; distance: cosine or l2.

    Queries of up to MATRIX_CELLS numbers go to every task as a matrix, and each batch hands on its k best of each query; more
    are cut into blocks of so many, and every block meets every tile of ROWS_AT_ONCE rows. A row is no neighbour of the query
    with its own vec_id. Cosine with a vector of zeros is 0; rows and queries without a vector are left out; a shorter vector
    counts as if zeros followed. Without queries there are no rows.
    """
    asked = queries.select("query_id", "query_vector").where("query_vector is not null")
    n, dims = asked.agg(F.count("*"), F.max(F.size("query_vector"))).first()
    if n * max(dims or 0, 1) <= MATRIX_CELLS:
        out = _nearest(corpus, asked, distance, k, key)
    else:
        out = _nearest_by_blocks(corpus, asked, -(-n * dims // MATRIX_CELLS), distance, k, key)
    order = [F.desc("distance") if distance == "cosine" else F.asc("distance"), *map(F.asc, key)]
    return top_k(out, "query_id", order, k).select("query_id", "rank", *key, "distance")


def matrix_of(lists: pa.Array, dims: int = 0) -> np.ndarray:
    """Vectors as rows of a matrix, with zeros after the shorter ones; it has dims columns at least."""
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(lists), max(int(sizes.max(initial=0)), dims)))
    row = np.repeat(np.arange(len(lists)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.nan_to_num(flat)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _near_schema(corpus: DataFrame, asked: DataFrame, key: tuple[str, ...]) -> StructType:
    return StructType([asked.schema["query_id"], *[corpus.schema[c] for c in key], StructField("distance", DoubleType())])


def _best_of(keys: list[pa.Array], rows: pa.Array, ids: pa.Array, matrix: np.ndarray, distance: str, k: int, own: bool, schema: pa.Schema) -> pa.RecordBatch:
    """The k best rows for each query, and those that are as near as the last of them; own: the key is a vec_id."""
    x = matrix_of(rows, matrix.shape[1])
    matrix = np.pad(matrix, ((0, 0), (0, x.shape[1] - matrix.shape[1])))
    if distance == "cosine":
        near = -(_unit(matrix) @ _unit(x).T)
    else:
        near = (matrix * matrix).sum(axis=1)[:, None] + (x * x).sum(axis=1) - 2 * (matrix @ x.T)
        if not np.isfinite(near).all():
            near = np.stack([((x - q) ** 2).sum(axis=1) for q in matrix])
    if own and keys[0].type == ids.type:
        at = pc.fill_null(pc.index_in(keys[0], value_set=ids), -1).to_numpy(zero_copy_only=False)
        near[at[at >= 0], np.flatnonzero(at >= 0)] = np.inf
    # products of matrices err by far less than this; what may be among the k is then weighed exactly
    last = np.partition(near, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
    spare = 1e-5 + 1e-9 * np.abs(near[np.isfinite(near)]).max(initial=0)
    if distance == "l2":
        spare += 1e-12 * ((matrix * matrix).sum(axis=1).max(initial=0) + (x * x).sum(axis=1).max(initial=0))
    q, at = np.nonzero((near <= last[:, None] + spare) & np.isfinite(near))
    if distance == "cosine":
        score = np.round(near[q, at], 6)
    else:
        score, step = np.empty(len(q)), max(1, MATRIX_CELLS // max(matrix.shape[1], 1))
        for begin in range(0, len(q), step):
            some = slice(begin, begin + step)
            score[some] = np.round(((x[at[some]] - matrix[q[some]]) ** 2).sum(axis=1), 6)
    counts = np.bincount(q, minlength=len(matrix))
    place = np.cumsum(counts) - counts + np.minimum(k, counts) - 1
    last = np.full(len(matrix), -np.inf)
    last[counts > 0] = score[np.lexsort((score, q))][place[counts > 0]]
    stay = score <= last[q]
    q, at, found = q[stay], at[stay], -score[stay] if distance == "cosine" else score[stay]
    columns = [ids.take(pa.array(q)), *[c.take(pa.array(at)) for c in keys], pa.array(found + 0.0)]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _nearest(corpus: DataFrame, asked: DataFrame, distance: str, k: int, key: tuple[str, ...]) -> DataFrame:
    schema = _near_schema(corpus, asked, key)
    arrow, got = to_arrow_schema(schema), asked.toArrow()  # MATRIX_CELLS numbers at most
    ids, matrix = got.column("query_id").combine_chunks(), matrix_of(got.column("query_vector").combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(begin, ROWS_AT_ONCE)
                part = part.filter(part.column("embedding").is_valid())
                if part.num_rows and len(ids):
                    yield _best_of([part.column(c) for c in key], part.column("embedding"), ids, matrix, distance, k, key == ("vec_id",), arrow)

    return corpus.select(*key, "embedding").mapInArrow(run, schema)


def _nearest_by_blocks(corpus: DataFrame, asked: DataFrame, blocks: int, distance: str, k: int, key: tuple[str, ...]) -> DataFrame:
    """The same for more queries: blocks of queries and tiles of rows in work tables, a row each, that all meet."""
    schema = _near_schema(corpus, asked, key)
    arrow = to_arrow_schema(schema)
    tile = StructType([StructField("tile", ArrayType(StructType([corpus.schema[c] for c in (*key, "embedding")])))])
    tile_arrow = to_arrow_schema(tile)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(begin, ROWS_AT_ONCE)
                rows = pa.StructArray.from_arrays(part.columns, names=part.schema.names)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows).cast(tile_arrow[0].type)], schema=tile_arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, queries = batch.column("tile")[i].values, batch.column("asked")[i].values
                ids, matrix = queries.field("query_id"), matrix_of(queries.field("query_vector"))
                yield _best_of([rows.field(c) for c in key], rows.field("embedding"), ids, matrix, distance, k, key == ("vec_id",), arrow)

    tiles = materialize(corpus.select(*key, "embedding").where("embedding is not null").mapInArrow(packed, tile), "tiles", FILE_OPTIONS)
    parts = asked.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(2 * blocks)).alias("block")).agg(F.collect_list(F.struct("query_id", "query_vector")).alias("asked"))
    return tiles.crossJoin(materialize(parts, "asked", FILE_OPTIONS).select("asked")).mapInArrow(run, schema)  # tiles x blocks of the query set


def text_vectors(index: Index, queries: DataFrame, query: str = "item_id", k: int = 5) -> DataFrame:
    """The k rows of an index whose hashed vectors are nearest to those of the queries' texts, by cosine."""
    terms = query_terms(queries, query).select(query, "term", F.col("qtf").alias("count"), F.lit(0.0).alias("weight"))
    scored = best_rows(index, query_blocks(terms, queries, query), Cosine(), query, k)
    return top_k(scored, query, [F.desc("score"), *map(F.asc, index.key)], k).select(query, "rank", *index.key, "score")


def hyde(index: Index, queries: DataFrame, query: str = "item_id", k: int = 5) -> DataFrame:
    """The same for a passage that would answer the query, in place of the query."""
    return text_vectors(index, queries.withColumn("text", providers.passage(F.col("text"))), query, k)


def first_of(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key. Partial aggregation keeps one row of a key for each task before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    low = F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_low")
    return df.groupBy(*key).agg(low).select(*key, *[F.col(f"_low.{c}").alias(c) for c in rest])


def hybrid(lists: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """Rank lists one after the other, with the name of each."""
    out = None
    for n, (name, df) in enumerate(lists.items()):
        part = df.select(*columns).withColumn("method", F.lit(name)).withColumn("method_order", F.lit(n))
        out = part if out is None else out.unionByName(part)
    return out


def single_metrics(hits: DataFrame, query: str | list[str], k: int = 5) -> DataFrame:
    """hit_rate, mrr, precision and (unnormalised) ndcg of each query (or pair of columns) from rank and hit (0 or 1; null: no result)."""
    gain = F.col("hit") / F.log2(F.col("rank") + 1)
    return hits.groupBy(*([query] if isinstance(query, str) else query)).agg(
        F.coalesce(F.max("hit"), F.lit(0)).cast("double").alias("hit_rate"),
        F.round(F.coalesce(1 / F.min(F.when(F.col("hit") == 1, F.col("rank"))), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.coalesce(F.sum("hit"), F.lit(0)) / k, 6).alias("precision"),
        F.round(F.coalesce(F.sum(gain), F.lit(0.0)), 6).alias("ndcg"),
    )


def multi_metrics(ranked: DataFrame, relevant: DataFrame, query: str, k: int = 5) -> DataFrame:
    """precision, recall, hit_rate, mrr and ndcg of each query. ranked: rank, hit; relevant: query and n_relevant."""
    rows = relevant.join(ranked, query, "left")
    inside = F.when(F.col("rank") <= k, F.col("hit")).otherwise(0)
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("n_relevant"), F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    out = rows.groupBy(query, "n_relevant").agg(F.sum(inside).alias("hits"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"), F.sum(inside / F.log2(F.col("rank") + 1)).alias("dcg"))
    return out.select(
        query,
        F.round(F.coalesce("hits", F.lit(0)) / k, 6).alias("precision"),
        F.round(F.when(F.col("n_relevant") > 0, F.coalesce("hits", F.lit(0)) / F.col("n_relevant")).otherwise(0.0), 6).alias("recall"),
        (F.coalesce("hits", F.lit(0)) > 0).cast("double").alias("hit_rate"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.when(F.col("n_relevant") > 0, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(0.0), 6).alias("ndcg"),
    )


def summary(rows: DataFrame, group: list[str], metrics: dict[str, Column]) -> DataFrame:
    """Row count and means of each group; nulls count as 0 in the mean."""
    each = [F.round(F.sum(F.coalesce(c.cast("double"), F.lit(0.0))) / F.count("*"), 4).alias(name) for name, c in metrics.items()]
    return rows.groupBy(*group).agg(F.count("*").alias("rows"), *each)


def means(rows: DataFrame, columns: list[str], group: list[str] | None = None) -> DataFrame:
    """Means of those of the columns that rows has; nulls and NaN count for nothing."""
    have = [c for c in columns if c in rows.columns]
    return rows.groupBy(*(group or [])).agg(*[F.round(F.avg(F.nullif(F.col(c).cast("double"), F.lit(float("nan")))), 6).alias(c) for c in have])


def metric_map(entries: Column) -> Column:
    """A judge's list of structs of key, score and value as a map; the score wins, and of repeated keys the last one."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.coalesce(last(k)["score"], last(k)["value"])))


def judge_pass(*scores: Column) -> Column:
    """1 if all scores are 1, else 0."""
    out = F.lit(True)
    for s in scores:
        out = out & F.coalesce(s == 1, F.lit(False))
    return out.cast("int")


#: Characters of the pieces by which one name is looked for in another.
GRAM = 4


def match_names(names: DataFrame, catalog: DataFrame, shared: int = 3) -> DataFrame:
    """Catalogue entries (file) that may belong to each name: one normalised form holds the other, or enough words agree."""
    n, f = names.select("name").distinct().where("name is not null"), catalog.select("file").distinct().where("file is not null")
    pairs = name_candidates(n, f, shared)
    a, b = T.normal_name(F.col("name")), T.normal_name(F.col("file"))
    alike = a.contains(b) | b.contains(a) | (F.size(F.array_intersect(T.name_tokens(F.col("name")), T.name_tokens(F.col("file")))) >= shared)
    found = pairs.where(alike & (a != "") & (b != "")).groupBy("name").agg(F.array_sort(F.collect_set("file")).alias("files"))
    out = n.join(found, "name", "left").withColumn("n_files", F.coalesce(F.size("files"), F.lit(0)))
    kind = F.when(F.col("n_files") == 1, "confident").when(F.col("n_files") > 1, "ambiguous").otherwise("unmatched")
    return out.select("name", F.coalesce(F.array_join("files", "|"), F.lit("")).alias("files"), "n_files", kind.alias("match_class"))


def name_candidates(names: DataFrame, files: DataFrame, shared: int = 3) -> DataFrame:
    """Pairs (name, file) among which are all that match_names looks for, from distinct names and files.

    Words are in order of rarity over both sides. Two sets with `shared` words in common have one of them among all but the
    shared - 1 most common words of each, so only these meet. One form that another holds is looked for by the piece of GRAM
    characters that fewest forms of the other side have (shorter forms: by themselves); a piece that none has ends the search.
    """

    def prefixes(df: DataFrame, column: str, rarity: DataFrame) -> DataFrame:
        each = df.select(column, F.explode(T.name_tokens(F.col(column))).alias("key")).join(rarity, "key")
        place = F.row_number().over(Window.partitionBy(column).orderBy("n", "key"))
        size = F.count("*").over(Window.partitionBy(column))  # a name's words
        return each.withColumns({"place": place, "size": size}).where(F.col("place") <= F.col("size") - (shared - 1)).select(column, "key")

    def pieces(df: DataFrame, column: str, size: Column) -> Column:
        whole = T.normal_name(F.col(column))
        last = F.length(whole) - size + 1
        return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda s: F.substring(whole, s, size))))

    def held_in(inner: DataFrame, one: str, outer: DataFrame, other: str) -> DataFrame:
        own = inner.select(one, T.normal_name(F.col(one)).alias("whole")).where("whole <> ''")
        sizes = [r[0] for r in own.where(F.length("whole") < GRAM).select(F.length("whole")).distinct().collect()]  # at most GRAM - 1
        held = None
        for size in [*sorted(sizes), GRAM]:
            mine = own.where(F.length("whole") >= size if size == GRAM else F.length("whole") == size)
            postings = outer.select(other, F.explode(pieces(outer, other, F.lit(size))).alias("key"))
            counts = postings.groupBy("key").agg(F.count("*").alias("n"))
            keys = mine.select(one, F.explode(pieces(mine, one, F.lit(size))).alias("key")).join(counts, "key", "left")
            rarest = keys.groupBy(one).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("k")).where("k.n > 0").select(one, F.col("k.key").alias("key"))
            got = rarest.join(postings, "key").select("name", "file")
            held = got if held is None else held.union(got)
        return held

    rarity = names.select(F.explode(T.name_tokens(F.col("name"))).alias("key")).union(files.select(F.explode(T.name_tokens(F.col("file"))))).groupBy("key").agg(F.count("*").alias("n"))
    words = prefixes(names, "name", rarity).join(prefixes(files, "file", rarity), "key").select("name", "file")
    return words.union(held_in(names, "name", files, "file")).union(held_in(files, "file", names, "name")).distinct()


def unique_list(items: Column) -> Column:
    """Entries of an array, each where it comes first; nulls and empty strings are left out."""
    return F.array_distinct(F.filter(items, lambda s: s.isNotNull() & (s != "")))


def count_report(n: Column) -> Column:
    """What a counting tool answers."""
    return F.concat(F.lit("Total chunks in knowledge base: "), n.cast("string"))
