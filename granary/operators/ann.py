"""Approximate nearest neighbours: cells of k-means, product codes of the residuals, and exact distances of the best.

Cells and codes are learnt from at most SAMPLE_NUMBERS numbers of vectors, picked by a hash; every vector is indexed. The index
is two tables, both partitioned by cell: tiles of codes, and the vectors themselves. Cells that many vectors share are split
over tasks and files (REBALANCE), so copies of one vector don't meet in one task.

A search takes the cells nearest to each query, meets their tiles of codes with the queries that probe them, a row for each
tile and block of queries, keeps the best candidates of a tile by the codes' distance, and works out the exact distance of the
best of all tiles from the vectors. Distances are cosine (vectors are brought to length 1 first) or l2.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType, IntegerType, StructField, StructType

from ..functions import text as T
from ..sources.work import folder, materialize
from .index import FILE_OPTIONS
from .retrieval import matrix_of, top_k

#: Numbers of vectors that the model is fitted on; cells at most; rows a tile; entries of a vector that share a code.
SAMPLE_NUMBERS, MOST_CELLS, TILE, PART = 4_000_000, 1_024, 4_096, 4
ROUNDS, SEED = 12, 3
#: Rows of the sample that ask for so many neighbours each, and the share of them that probes and candidates must bring up.
ASKING, NEIGHBOURS, AIM = 256, 5, 0.985
#: Queries in a block.
BLOCK_QUERIES = 2_000


class Model(NamedTuple):
    """Centres of the cells, and for each part of a residual the vectors that codes stand for; what a search needs by the sample."""

    centres: np.ndarray
    books: list[np.ndarray]
    unit: bool
    probes: int = 16
    candidates: int = 60

    def brought(self, x: np.ndarray) -> np.ndarray:
        x = np.pad(x, ((0, 0), (0, max(0, self.centres.shape[1] - x.shape[1]))))[:, : self.centres.shape[1]]
        return _unit(x) if self.unit else x

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, i : i + PART] for i in range(0, x.shape[1], PART)]

    def coded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and codes of every row."""
        cell = nearest(x, self.centres)
        codes = [nearest(p, b) for p, b in zip(self.parts(x - self.centres[cell]), self.books, strict=True)]
        return cell, np.stack(codes, axis=1).astype(np.uint8)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all of y."""
    return (x * x).sum(axis=1)[:, None] - 2 * x @ y.T + (y * y).sum(axis=1)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([squares(x[i : i + TILE], centres).argmin(axis=1) for i in range(0, len(x), TILE)] or [np.zeros(0, np.int64)])


def k_means(x: np.ndarray, n: int) -> np.ndarray:
    """Centres by Lloyd's rounds, from distinct rows; an empty cell takes the row that is farthest from its centre."""
    x = x[np.sort(np.unique(x, axis=0, return_index=True)[1])]
    rng = np.random.default_rng(SEED)
    centres = x[rng.choice(len(x), min(n, len(x)), replace=False)].copy()
    for _ in range(ROUNDS if len(centres) < len(x) else 0):
        own = nearest(x, centres)
        counts = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres = np.where(counts[:, None] > 0, total / np.maximum(counts, 1)[:, None], centres)
        if (empty := np.flatnonzero(counts == 0)).size:
            far = np.argsort(-((x - centres[own]) ** 2).sum(axis=1))[: len(empty)]
            centres[empty] = x[far]
    return centres


def train(corpus: DataFrame, distance: str, key: tuple[str, ...] = ("vec_id",)) -> Model | None:
    """The model of a corpus (key, embedding), from a bounded sample of it; None without vectors."""
    has = corpus.where("embedding is not null and size(embedding) > 0")
    n, dims = has.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not n:
        return None
    most = max(SAMPLE_NUMBERS // dims, 1)
    share = F.pmod(F.xxhash64(*key), F.lit(1 << 30)) / float(1 << 30)
    got = has.where(share < min(1.0, most / n)).select("embedding").limit(2 * most).toArrow()
    x = matrix_of((got if got.num_rows else has.select("embedding").limit(1).toArrow()).column("embedding").combine_chunks(), dims)
    unit = distance == "cosine"
    x = _unit(x) if unit else x
    centres = k_means(x, int(min(MOST_CELLS, max(1, round(np.sqrt(min(n, len(x))))))))
    rest = x - centres[nearest(x, centres)]
    return tuned(Model(centres, [k_means(rest[:, i : i + PART], min(256, max(1, len(rest) // 8))) for i in range(0, dims, PART)], unit), x)


def tuned(model: Model, x: np.ndarray) -> Model:
    """The model with as many probes and candidates as bring up a share AIM each of the sample's own neighbours.

    Some rows of the sample ask; their exact neighbours tell how far down the list of cells, and of guesses, they lie.
    """
    asking = np.unique(np.linspace(0, len(x) - 1, min(ASKING, len(x))).astype(np.int64))
    cell, codes = model.coded(x)
    cell_rank, guess_rank = [], []
    for q in asking.tolist():
        away = ((x - x[q]) ** 2).sum(axis=1)
        away[q] = np.inf
        near = np.argsort(away, kind="stable")[: min(NEIGHBOURS, len(x) - 1)]
        to_cells = squares(x[q : q + 1], model.centres)[0]
        cell_rank += (to_cells[None] < to_cells[cell[near]][:, None]).sum(axis=1).tolist()
        rest = x[q] - model.centres[cell]  # a query's residual is another for each cell
        guess = sum(((p - b[codes[:, j]]) ** 2).sum(axis=1) for j, (p, b) in enumerate(zip(model.parts(rest), model.books, strict=True)))
        guess[q] = np.inf
        guess_rank += (guess[None] < guess[near][:, None]).sum(axis=1).tolist()
    if not cell_rank:
        return model
    most = lambda ranks: int(np.quantile(ranks, AIM, method="higher")) + 1
    return model._replace(probes=max(model.probes, most(cell_rank)), candidates=max(model.candidates, 2 * most(guess_rank)))


class Cells(NamedTuple):
    """The index: its model, tiles (cell, keys, codes) and rows (cell, key, embedding)."""

    model: Model | None
    tiles: DataFrame
    rows: DataFrame
    key: tuple[str, ...]
    distance: str


def build(corpus: DataFrame, distance: str, key: tuple[str, ...] = ("vec_id",)) -> Cells:
    """Trains a model and writes the index of all rows that have a vector."""
    model = train(corpus, distance, key)
    rows = StructType([*(corpus.schema[c] for c in key), corpus.schema["embedding"], StructField("codes", BinaryType()), StructField("cell", IntegerType())])
    arrow = to_arrow_schema(rows)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, TILE):
                part = batch.slice(begin, TILE)
                cell, codes = model.coded(model.brought(matrix_of(part.column("embedding"))))
                columns = [*part.columns, pa.array(list(map(bytes, codes)), pa.binary()), pa.array(cell.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    tile = StructType([StructField("keys", ArrayType(StructType([corpus.schema[c] for c in key]))), StructField("codes", BinaryType()), StructField("cell", IntegerType())])
    tile_arrow = to_arrow_schema(tile)

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of the cell; a tile is of one cell."""
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            starts = np.flatnonzero(np.diff(cells, prepend=-1))
            for a, b in zip(starts, [*starts[1:], len(cells)], strict=True):
                for i in range(a, b, TILE):
                    part = batch.slice(i, min(TILE, b - i))
                    keys = pa.StructArray.from_arrays([part.column(c) for c in key], names=list(key))
                    columns = [pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.array([b"".join(part.column("codes").to_pylist())]), part.column("cell").slice(0, 1)]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, tile_arrow, strict=True)], schema=tile_arrow)

    has = corpus.select(*key, "embedding").where("embedding is not null and size(embedding) > 0")
    coded = has.mapInArrow(code, rows) if model else corpus.sparkSession.createDataFrame([], rows)
    dealt = coded.hint("rebalance", F.col("cell"))  # rows of a cell side by side, large cells in several tasks
    written = _by_cell(dealt, "cells")
    tiles = _by_cell(written.sortWithinPartitions("cell").select(*key, "codes", "cell").mapInArrow(tiled, tile), "tiles")
    return Cells(model, tiles, written.drop("codes"), key, distance)


def _by_cell(df: DataFrame, name: str) -> DataFrame:
    import uuid

    path = f"{folder(df.sparkSession)}/granary/{name}-{uuid.uuid4().hex}"
    df.write.options(**FILE_OPTIONS).partitionBy("cell").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def search(index: Cells, queries: DataFrame, k: int = 5, probes: int | None = None, candidates: int | None = None) -> DataFrame:
    """The k nearest rows that the index finds for every query (query_id, query_vector), with their exact distance.

    probes: cells looked into; candidates: rows of each query that get their exact distance; None: as many as the model needed
    for its own sample. A row is no neighbour of the query
    with its own vec_id.
    """
    model, key = index.model, index.key
    asked = queries.select("query_id", "query_vector").where("query_vector is not null and size(query_vector) > 0")
    if model is None:
        asked = asked.limit(0)
    else:
        probes, candidates = probes or model.probes, candidates or model.candidates
    probing = StructType([StructField("query_id", asked.schema["query_id"].dataType), StructField("vector", ArrayType(FloatType())), StructField("cell", IntegerType())])
    arrow = to_arrow_schema(probing)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = model.brought(matrix_of(batch.column("query_vector")))
                n = min(probes, len(model.centres))
                near = np.argpartition(squares(x, model.centres), n - 1, axis=1)[:, :n]
                row = pa.array(np.repeat(np.arange(len(x)), n))
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel().astype(np.float32)))
                yield pa.RecordBatch.from_arrays([batch.column("query_id").take(row), vectors.take(row).cast(arrow[1].type), pa.array(near.ravel().astype(np.int32))], schema=arrow)

    each = asked.mapInArrow(probe, probing)
    blocks = max(-(-asked.count() // BLOCK_QUERIES), 1)
    blocks = each.groupBy("cell", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).agg(F.collect_list(F.struct("query_id", "vector")).alias("asked")).select("cell", "asked")
    found = StructType([StructField("query_id", asked.schema["query_id"].dataType), *index.tiles.schema["keys"].dataType.elementType.fields, StructField("cell", IntegerType()), StructField("guess", DoubleType())])
    found_arrow = to_arrow_schema(found)

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The candidates of each query in a tile, by the sum of its codes' distances."""
        for batch in batches:
            for i in range(batch.num_rows):
                cell, keys = batch.column("cell")[i].as_py(), batch.column("keys")[i].values
                codes = np.frombuffer(batch.column("codes")[i].as_py(), np.uint8).reshape(len(keys), len(model.books))
                block = batch.column("asked")[i].values
                ids, x = block.field("query_id"), matrix_of(block.field("vector")) - model.centres[cell]
                tables = [squares(p, b) for p, b in zip(model.parts(x), model.books, strict=True)]
                near = sum(t[:, codes[:, j]] for j, t in enumerate(tables))
                n = min(candidates + 1, len(keys))
                at = np.argpartition(near, n - 1, axis=1)[:, :n]
                q = np.repeat(np.arange(len(ids)), n)
                columns = [ids.take(pa.array(q)), *keys.take(pa.array(at.ravel())).flatten(), pa.array(np.full(len(q), cell, np.int32)), pa.array(near[q, at.ravel()])]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, found_arrow, strict=True)], schema=found_arrow)

    guessed = index.tiles.join(blocks, "cell").select("cell", "keys", "codes", "asked").mapInArrow(guess, found)
    if key == ("vec_id",) and asked.schema["query_id"].dataType == index.rows.schema["vec_id"].dataType:
        guessed = guessed.where("query_id <> vec_id")
    best = materialize(top_k(guessed, "query_id", [F.asc("guess"), *map(F.asc, key)], candidates or 1).drop("rank"), "candidates")
    exact = index.rows.join(best, ["cell", *key]).join(asked, "query_id")
    away = F.round(T.cosine(F.col("query_vector"), F.col("embedding")) if index.distance == "cosine" else T.squared_l2(F.col("query_vector"), F.col("embedding")), 6)
    order = [F.desc("distance") if index.distance == "cosine" else F.asc("distance"), *map(F.asc, key)]
    return top_k(exact.select("query_id", *key, away.alias("distance")), "query_id", order, k).select("query_id", "rank", *key, "distance")


def recall(found: DataFrame, exact: DataFrame, key: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """n_queries, n_exact, n_found and recall: the share of the exact neighbours that were found."""
    both = exact.select("query_id", *key).join(found.select("query_id", *key, F.lit(1).alias("hit")), ["query_id", *key], "left")
    return both.agg(F.countDistinct("query_id").alias("n_queries"), F.count("*").alias("n_exact"), F.count("hit").alias("n_found")).withColumn("recall", F.round(F.col("n_found") / F.col("n_exact"), 6))
