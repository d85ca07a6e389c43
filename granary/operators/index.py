"""A lexical index by documents: groups of rows, each with the postings of its own rows, so that a search needs no shuffle.

A group is one row: its terms with the number of rows that have each, and one compressed value with all that a search needs,
the keys of its rows in order, their lengths, the terms again, and the postings (row of the group, count) term by term; with
each term goes its entry in hashed vectors, and the largest count and the smallest length it occurs with, which bound what the
term can add to a score whatever the mean length is. A search reads that value alone and opens one group at a time, so that neither a row group of
the file nor a batch holds many open groups. Texts are cut into tokens by Spark; a task then packs groups of at most
GROUP_ROWS rows and about GROUP_TOKENS tokens, without a shuffle.

A search takes its queries in blocks of about BLOCK_TERMS terms. Every block meets every group; a task adds up the scores of
the group in one array a query, leaves out a query whose bounds can't reach the best scores that the task has found already,
and hands on at most k rows of each group.

Rows are told apart as rows: two rows with one key are two rows, also with equal texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..functions import providers
from ..functions import text as T
from ..sources.versions import Versions
from ..sources.work import materialize
from .cutting import Bags, Texts, ranges

K1, B, EPSILON = 1.5, 0.75, 0.25
GROUP_ROWS, GROUP_TOKENS = 4_096, 1_000_000
#: Bytes of the texts that are cut into chunks at once.
CUT_BYTES = 2_000_000
#: Products of a group's rows and queries that are held at once.
BOUND_CELLS = 2_000_000
#: Terms of queries in a block.
BLOCK_TERMS = 50_000
#: Bytes of a row group in the files of groups, so that a reader holds few groups at once; without the second option a writer
#: looks at the bytes from the hundredth row on only, however large a row is.
FILE_OPTIONS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1"}


def key_fields(docs: DataFrame, key: list[str]) -> StructType:
    return StructType([StructField(k, docs.schema[k].dataType) for k in key])


#: The columns of groups of rows.
GROUP = StructType([StructField("n_rows", LongType()), StructField("n_tokens", LongType()), StructField("terms", ArrayType(StringType())), StructField("sizes", ArrayType(IntegerType())), StructField("packed", BinaryType())])
#: The lists in a packed group.
PACKED = ("keys", "terms", "lengths", "sizes", "rows", "counts", "most", "least", "slots")


def _list(values: pa.Array) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array([0, len(values)], pa.int64()), values)


def _small(numbers: np.ndarray) -> pa.Array:
    """Numbers from 0 on in as few bytes each as hold the largest."""
    return pa.array(numbers.astype(np.min_scalar_type(int(numbers.max(initial=0)))))


def _packed(table: pa.Table, key: list[str]) -> pa.RecordBatch:
    """One group of the rows of a table that has the key's columns and bag."""
    table = table.combine_chunks()
    if key:
        table = table.take(pc.sort_indices(table, sort_keys=[(k, "ascending") for k in key], null_placement="at_start"))
    bags = table.column("bag").combine_chunks()
    tokens = bags.flatten().dictionary_encode()
    columns = [table.column(k).combine_chunks() for k in key]
    lengths = pc.list_value_length(bags).to_numpy(zero_copy_only=False).astype(np.int64)
    return _group(columns, key, lengths, tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64), tokens.dictionary, _slots(tokens.dictionary))


def _group(columns: list[pa.Array], key: list[str], lengths: np.ndarray, tokens: np.ndarray, terms: pa.Array, slots: np.ndarray) -> pa.RecordBatch:
    """One group of rows in order of the key, with their tokens (numbers of terms) one row after the other; slots: of the terms."""
    n = len(lengths)
    pair, counts = np.unique(tokens * n + np.repeat(np.arange(n), lengths), return_counts=True)
    term, row = pair // max(n, 1), pair % max(n, 1)
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    sizes = np.diff(np.append(starts, len(term)))
    most = np.maximum.reduceat(counts, starts) if len(starts) else counts
    least = np.minimum.reduceat(lengths[row], starts) if len(starts) else counts
    terms, slots = terms.take(pa.array(term[starts])), slots[term[starts]]
    keys = pa.StructArray.from_arrays(columns, names=key) if key else pa.array([{}] * n, pa.struct([]))
    lists = [keys, terms, *map(_small, (lengths, sizes, row, counts, most, least, slots))]
    inside = pa.RecordBatch.from_arrays([_list(x) for x in lists], list(PACKED))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, inside.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(inside)
    out = [pa.array([n], pa.int64()), pa.array([int(lengths.sum())], pa.int64()), _list(terms), _list(pa.array(sizes)), pa.array([sink.getvalue().to_pybytes()])]
    schema = to_arrow_schema(GROUP)
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(out, schema, strict=True)], schema=schema)


def groups(docs: DataFrame, key: list[str]) -> DataFrame:
    """Groups of all rows of docs (key, text), packed by each task of its own rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, tokens = [], 0, 0
        for batch in batches:
            sizes = np.cumsum(pc.list_value_length(batch.column("bag")).to_numpy(zero_copy_only=False))
            begin, base = 0, 0
            while begin < batch.num_rows:
                # as many rows as the group still takes, one at least
                end = max(begin + 1, min(begin + GROUP_ROWS - rows, int(np.searchsorted(sizes, base + GROUP_TOKENS - tokens, "right"))))
                end = min(end, batch.num_rows)
                held.append(batch.slice(begin, end - begin))
                rows, tokens = rows + end - begin, tokens + int(sizes[end - 1]) - base
                begin, base = end, int(sizes[end - 1])
                if rows >= GROUP_ROWS or tokens >= GROUP_TOKENS or begin < batch.num_rows:
                    yield _packed(pa.Table.from_batches(held), key)
                    held, rows, tokens = [], 0, 0
        if rows:
            yield _packed(pa.Table.from_batches(held), key)

    return docs.select(*key, T.tokens(F.coalesce("text", F.lit(""))).alias("bag")).mapInArrow(run, GROUP)


def chunk_groups(docs: DataFrame, key: list[str], cut: Callable[[Texts], Bags]) -> DataFrame:
    """Groups of the chunks of docs (text and the first column of the key); the key's second is a chunk's place in its document."""

    def packed(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bags = cut(Texts(rows.column("text").to_pylist()))
        slots = _slots(bags.terms)
        documents = rows.column(key[0])
        order = np.lexsort((bags.place, pc.rank(documents, null_placement="at_start", tiebreaker="dense").to_numpy()[bags.doc]))
        doc, place, begin, sizes = bags.doc[order], bags.place[order], bags.begin[order], (bags.end - bags.begin)[order]
        tokens = np.append(0, np.cumsum(sizes))
        parts = max(-(-len(order) // GROUP_ROWS), min(len(order), -(-int(tokens[-1]) // GROUP_TOKENS)))
        # even parts by tokens, of GROUP_ROWS rows at most
        ends = np.searchsorted(tokens[1:], tokens[-1] * np.arange(1, parts) / max(parts, 1)).tolist()
        at = 0
        for end in [*ends, len(order)]:
            while at < end:
                some = slice(at, min(end, at + GROUP_ROWS))
                columns = [documents.take(pa.array(doc[some])), pa.array(place[some], pa.int32())]
                yield _group(columns, key, sizes[some], bags.ids[ranges(begin[some], sizes[some])], bags.terms, slots)
                at = some.stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
            begin = 0
            while begin < batch.num_rows:
                end = max(begin + 1, int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + CUT_BYTES, "right")))
                yield from packed(batch.slice(begin, end - begin))
                begin = end

    return docs.where("text is not null").select(key[0], "text").mapInArrow(run, GROUP)


def term_counts(table: DataFrame) -> DataFrame:
    """term and df of a table of groups: the groups' own numbers of rows, added up."""
    each = table.select(F.explode(F.arrays_zip("terms", "sizes")).alias("t"))
    return each.groupBy(F.col("t.terms").alias("term")).agg(F.sum(F.col("t.sizes").cast("long")).alias("df"))


def totals(table: DataFrame) -> dict[str, int]:
    n, tokens = table.agg(F.sum("n_rows"), F.sum("n_tokens")).first()
    return {"rows": n or 0, "tokens": tokens or 0}


class Index:
    """Groups and terms in tables, and what else BM25 needs of all rows."""

    def __init__(self, table: DataFrame, terms: DataFrame, fields: StructType, rows: int, tokens: int):
        self.groups, self.terms, self.fields, self.key, self.rows = table, terms, fields, fields.names, rows
        self.mean_length = max(tokens, 1) / max(rows, 1)

    @cached_property
    def statistics(self) -> DataFrame:
        """term, df and idf in a work table; a negative idf becomes EPSILON times the mean over the vocabulary."""
        stats = self.terms.withColumn("idf0", F.log(F.lit(self.rows + 0.5) - F.col("df")) - F.log(F.col("df") + 0.5))
        mean = F.broadcast(stats.agg(F.avg("idf0").alias("mean_idf")))  # one row
        idf = F.when(F.col("idf0") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("idf0"))
        return materialize(stats.join(mean, F.lit(True)).select("term", "df", idf.alias("idf")), "terms")


def unpacked(value: pa.BinaryScalar) -> dict:
    """The lists of a packed group as arrays."""
    with pa.ipc.open_stream(value.as_buffer()) as reader:
        row = reader.read_next_batch()
    return {name: row.column(name)[0].values for name in PACKED if name in row.schema.names}


class Group:
    """The arrays of one group."""

    def __init__(self, row: dict):
        self.keys, self.terms = row["keys"], row["terms"]
        self.lengths, self.sizes, self.rows, self.counts, self.most, self.least = (row[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lengths", "sizes", "rows", "counts", "most", "least"))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self._slots = row.get("slots")

    @cached_property
    def slots(self) -> np.ndarray:
        """The terms' entries in hashed vectors; groups of kept indexes from before they were packed have none."""
        return _slots(self.terms) if self._slots is None else self._slots.to_numpy(zero_copy_only=False).astype(np.int64)


def lexical_index(docs: DataFrame, key: list[str], cut: Callable[[Texts], Bags] | None = None) -> Index:
    """Reads and cuts all texts once, into a work table of groups; cut: a function of cutting.py, whose chunks are the rows."""
    table = materialize(chunk_groups(docs, key, cut) if cut else groups(docs, key), "groups", FILE_OPTIONS)
    n = totals(table)
    fields = StructType([docs.schema[key[0]], StructField(key[1], IntegerType())]) if cut else key_fields(docs, key)
    return Index(table, term_counts(table), fields, n["rows"], n["tokens"])


class Asked:
    """A block of queries as arrays: their ids, and each one's terms (numbers of `terms`) with a weight and a count."""

    def __init__(self, block: pa.StructScalar):
        self.ids = block["ids"].values
        sizes = pc.list_value_length(block["terms"].values).to_numpy(zero_copy_only=False).astype(np.int64)
        self.start = np.append(0, np.cumsum(sizes))
        flat = block["terms"].values.flatten()
        terms = flat.field("term").dictionary_encode()
        self.terms, self.term = terms.dictionary, terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.count = flat.field("count").to_numpy(zero_copy_only=False).astype(np.float64)
        self.weight = flat.field("weight").to_numpy(zero_copy_only=False).astype(np.float64)

    def of(self, q: int) -> slice:
        return slice(self.start[q], self.start[q + 1])

    @cached_property
    def vectors(self) -> np.ndarray:
        """Hashed counts of terms, of length 1; zeros for queries without terms."""
        query = np.repeat(np.arange(len(self.ids)), np.diff(self.start))
        out = np.bincount(query * providers.DIMS + _slots(self.terms)[self.term], self.count, len(self.ids) * providers.DIMS).reshape(-1, providers.DIMS)
        return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-300)


def query_blocks(terms: DataFrame, queries: DataFrame, query: str) -> DataFrame:
    """Blocks of queries of about BLOCK_TERMS terms, in a work table: a row is a block. terms: query, term, count, weight.

    A query without terms is in a block too.
    """
    each = queries.select(query).distinct().join(terms, query, "left").groupBy(query).agg(F.filter(F.sort_array(F.collect_list(F.struct("term", "count", "weight"))), lambda t: t["term"].isNotNull()).alias("terms"))
    n = each.agg(F.sum(F.size("terms") + 1)).first()[0] or 0
    block = F.pmod(F.xxhash64(query), F.lit(-(-n // BLOCK_TERMS) or 1)).alias("block")
    blocks = each.groupBy(block).agg(F.sort_array(F.collect_list(F.struct(query, "terms"))).alias("q"))
    return materialize(blocks.select(F.struct("block", F.col(f"q.{query}").alias("ids"), F.col("q.terms").alias("terms")).alias("asked")), "asked")


def _from(picked: np.ndarray, score: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rounds the scores of the rows picked, and leaves those of at least `least`."""
    score[picked] = np.round(score[picked], 6)
    return picked[score[picked] >= least], score


class Okapi:
    """Scores of a group's rows by BM25; weight is a term's count in the query times its idf."""

    def __init__(self, mean_length: float):
        self.mean = mean_length

    def impact(self, counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return counts * (K1 + 1) / (counts + K1 * (1 - B + B * lengths / self.mean))

    def prepare(self, group: Group, asked: Asked) -> np.ndarray:
        """What each query's score can reach in this group at most; -inf if no row has a term of it."""
        self.group, self.asked = group, asked
        self.here = pc.fill_null(pc.index_in(asked.terms, value_set=group.terms), -1).to_numpy(zero_copy_only=False)[asked.term]
        self.gain = self.impact(group.counts, group.lengths[group.rows])
        most = np.append(self.impact(group.most, group.least), 0)  # the last is that of no term
        reach = np.append(0, np.cumsum(np.maximum(asked.weight, 0) * most[self.here]))
        found = np.append(0, np.cumsum(self.here >= 0))
        reach, found = (x[asked.start[1:]] - x[asked.start[:-1]] for x in (reach, found))
        return np.where(found > 0, reach + 1e-5, -np.inf)

    def score(self, q: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """The rows that share a term with a query and score `least` at least, and the scores of all rows, theirs in six digits."""
        group, n = self.group, len(self.group.lengths)
        own, weight = self.here[self.asked.of(q)], self.asked.weight[self.asked.of(q)]
        own, weight = own[own >= 0], weight[own >= 0]
        sizes = group.sizes[own]
        at = np.repeat(group.starts[own] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        row = group.rows[at]
        score = np.bincount(row, self.gain[at] * np.repeat(weight, sizes), n)
        shares = score > 0 if (weight > 0).all() else np.bincount(row, minlength=n) > 0
        return _from(np.flatnonzero(shares & (score >= least - 1e-6)), score, least)


class Cosine:
    """Scores of a group's rows by the cosine of hashed counts of terms; rows and queries without terms match nothing."""

    def prepare(self, group: Group, asked: Asked) -> np.ndarray:
        n, dims = len(group.lengths), providers.DIMS
        rows = np.bincount(group.rows * dims + np.repeat(group.slots, group.sizes), group.counts, n * dims).reshape(n, dims)
        self.rows, self.picked = rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-300), np.flatnonzero(group.lengths)
        self.asking = asked.vectors
        # products of matrices tell which queries have a row that may be near enough; only those are weighed row by row
        rows, reach, step = self.rows.astype(np.float32).T, np.full(len(self.asking), -np.inf), max(1, BOUND_CELLS // max(n, 1))
        for begin in range(0, len(self.asking) if len(self.picked) else 0, step):
            some = slice(begin, begin + step)
            reach[some] = (self.asking[some].astype(np.float32) @ rows).max(axis=1) + 1e-4
        return np.where(self.asking.any(axis=1), reach, -np.inf)

    def score(self, q: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        score = self.rows @ self.asking[q]
        return _from(self.picked[score[self.picked] >= least - 1e-6], score, least)


def _slots(terms: pa.Array) -> np.ndarray:
    """The entry of a hashed vector that each term counts in, as providers.bucket has it."""
    return np.array([int.from_bytes(hashlib.md5(t.encode()).digest()[:4]) % providers.DIMS for t in terms.to_pylist()], np.int64)


def best_rows(index: Index, blocks: DataFrame, scorer, query: str, k: int, pad: bool = False) -> DataFrame:
    """query, key and score of the k best rows of each group for every query, and maybe fewer of later groups of a task.

    Every block of queries meets every group, a row each. pad: rows that share no term have score 0 and count too.
    """
    k, ids_of = max(1, k), blocks.schema["asked"].dataType["ids"].dataType.elementType
    schema = StructType([StructField(query, ids_of), *index.fields.fields, StructField("score", DoubleType())])
    arrow = to_arrow_schema(schema)

    def best_of(group: Group, asked: Asked, best: np.ndarray) -> pa.RecordBatch | None:
        """best: of each query, the best scores that this task has found."""
        reach = scorer.prepare(group, asked)
        reach = np.maximum(reach, 0) if pad else reach
        out = []
        for q in np.flatnonzero((reach >= best[:, 0]) & (reach > -np.inf)).tolist():
            picked, score = scorer.score(q, best[q, 0])
            if pad:  # rows that share no term score 0
                score = np.round(score, 6)
                picked = np.flatnonzero(score >= best[q, 0])
            if len(picked) > k:
                picked = picked[score[picked] >= -np.partition(-score[picked], k - 1)[k - 1]]
                picked = picked[np.lexsort((picked, -score[picked]))[:k]]  # rows of a group are in order of the key
            best[q] = np.sort(np.concatenate((best[q], score[picked])))[-k:]
            out.append((np.full(len(picked), q), picked, score[picked] + 0.0))
        if not out:
            return None
        q, row, score = map(np.concatenate, zip(*out, strict=True))
        columns = [asked.ids.take(pa.array(q)), *group.keys.take(pa.array(row)).flatten(), pa.array(score)]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            for value, block in zip(batch.column("packed"), batch.column("asked"), strict=True):
                if block["block"] not in known:
                    asked = Asked(block)
                    known[block["block"]] = asked, np.full((len(asked.ids), k), -np.inf)
                found = best_of(Group(unpacked(value)), *known[block["block"]])
                if found is not None:
                    yield found

    return index.groups.select("packed").crossJoin(blocks).mapInArrow(run, schema)  # groups x blocks of queries: a grid of rows, not of pairs


class KeptIndex:
    """An index in a folder that grows by batches: each commit has its groups, and its terms' numbers of rows.

    A batch of a name that is there already counts once. A search over all commits gives what one over an index of all their
    rows gives: numbers of rows and tokens come from the commits, those of terms are added up.
    """

    TERMS = "term string, df long"

    def __init__(self, spark: SparkSession, path: str, docs_schema: str, key: list[str]):
        self.versions, self.key = Versions(spark, path), key
        self.fields = key_fields(spark.createDataFrame([], docs_schema), key)

    def add(self, docs: DataFrame, batch: str | None = None) -> bool:
        """Adds the rows of docs in one commit; False if the batch is there already."""
        tables = {"groups": groups(docs, self.key), "terms": lambda written: term_counts(written["groups"])}
        return self.versions.add(tables, batch=batch, measure=lambda t: totals(t["groups"]), options=FILE_OPTIONS) is not None

    def open(self) -> Index:
        commits = self.versions.current()
        counts = self.versions.read("terms", self.TERMS, commits).groupBy("term").agg(F.sum("df").alias("df"))
        number = lambda n: int(sum(c["numbers"][n] for c in commits))
        return Index(self.versions.read("groups", GROUP, commits), counts, self.fields, number("rows"), number("tokens"))

    def compact(self) -> None:
        """One commit in place of all: fewer files, and one number a term."""
        commits = self.versions.current()
        if len(commits) > 1:
            now = self.open()
            numbers = {n: sum(c["numbers"][n] for c in commits) for n in ("rows", "tokens")}
            self.versions.add({"groups": now.groups, "terms": now.terms}, numbers=numbers, replaces=[c["folder"] for c in commits], options=FILE_OPTIONS)
