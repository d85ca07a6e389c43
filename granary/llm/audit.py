"""Audit of filters and of the order in which they are applied, by a packed bitmap index.

Every task packs its rows into bitsets of 64-bit words: one for the rows that fail each filter, one for each label, and one
for each part. Rows are sorted by part and each part starts a new word, so a part's bitset is a run of whole words, and only
its run is looked at: many parts cost no more than few. For every set of filters that can come first, and every filter that
can follow, AND-NOT of the failures' bitsets and counts of the remaining bits give what is kept, removed, redundant and lost;
the tasks' counts are added up by part, set and filter. The orders of the filters are then looked up in these sums.

Filters, on whole texts (null: empty); words are maximal runs of bytes but space, tab, line feed, vertical tab, form feed and
carriage return:
A: under 200 words; B: distinct words are under half; C: A-Z are over 3 in 100 code points; D: holds one of #$%&*|;
E: a document with a smaller doc_id has the same text, whether or not another filter removes it.

E compares sha256 digests: the smallest doc_id of each digest is found with partial sums in each task, and comes back by
doc_id and digest, so that no group of copies meets in one task.

Defined results: a null language is the part ''; a document without labels loses nothing; of several labels of one document
any that says 1 counts; a null doc_id never fails E and makes no other row fail, and has no labels; repeated rows of one
doc_id and text are not copies of each other. An empty table gives no rows. Other columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROWS_AT_ONCE, frugal, materialize

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT, SYMBOLS = 200, 50, 3, "#$%&*|"
#: Rows that a task packs at once; counts of several packs are added.
PACKED_ROWS = 1 << 20
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
_UPPER, _SYMBOLS = bytes(range(65, 91)), SYMBOLS.encode()


def failures(raw: bytes, n_chars: int) -> int:
    """Bits of the filters A to D that a text fails."""
    words = raw.split()  # of bytes: at ASCII white space
    few = len(words) < MIN_WORDS
    alike = 100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words)
    loud = 100 * (len(raw) - len(raw.translate(None, _UPPER))) > MAX_UPPER_PERCENT * n_chars
    odd = any(c in raw for c in _SYMBOLS)
    return few | alike << 1 | loud << 2 | odd << 3


def failing(docs: DataFrame) -> DataFrame:
    """doc_id, part, fails (bits of A to D) and digest of every row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(begin, ROWS_AT_ONCE)
                texts = pc.fill_null(part.column("text"), "")
                sizes, raw = pc.utf8_length(texts).to_pylist(), texts.cast(pa.binary()).to_pylist()
                fails = pa.array(map(failures, raw, sizes), pa.int32())
                digests = pa.array([hashlib.sha256(x).digest() for x in raw], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("part"), fails, digests], ["doc_id", "part", "fails", "digest"])

    return rows.mapInArrow(frugal(run), "doc_id long, part string, fails int, digest binary")


def with_copies(rows: DataFrame) -> DataFrame:
    """Adds filter E's bit to fails: set unless the row is the first, by doc_id, of those with its text."""
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    copied = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    return rows.join(first, ["doc_id", "digest"], "left").select("doc_id", "part", F.when(copied, F.col("fails").bitwiseOR(F.lit(16))).otherwise(F.col("fails")).alias("fails"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds good and toxic of the labels."""
    one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality"), one("toxic"))
    out = rows.join(known, "doc_id", "left")
    return out.select("part", "fails", F.coalesce("quality", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


class Bitmaps:
    """Bitsets of some rows; a part's rows are the words from its start to the next part's."""

    def __init__(self, part: np.ndarray, n_parts: int, fails: np.ndarray, good: np.ndarray, toxic: np.ndarray):
        counts = np.bincount(part, minlength=n_parts)
        words = -(-counts // 64)
        #: Parts without rows have no words; only those with rows take part in the sums.
        self.parts = np.flatnonzero(counts)
        self.starts = (np.cumsum(words) - words)[self.parts]
        order = np.argsort(part, kind="stable")
        rank = np.arange(len(part)) - np.repeat(np.cumsum(counts) - counts, counts)
        slot = np.repeat((np.cumsum(words) - words) * 64, counts) + rank
        size = int(words.sum()) * 64

        def packed(bits: np.ndarray) -> np.ndarray:
            out = np.zeros(size, bool)
            out[slot] = bits[order]
            return np.packbits(out).view(np.uint64)

        self.rows = packed(np.ones(len(part), bool))
        self.fails = [packed(fails >> i & 1 == 1) for i in range(len(FILTERS))]
        self.good, self.toxic = packed(good), packed(toxic)

    def count(self, bits: np.ndarray) -> np.ndarray:
        """Set bits of each part that has rows."""
        return np.add.reduceat(np.bitwise_count(bits).astype(np.int64), self.starts)

    def after(self, first: int, then: int) -> list[np.ndarray]:
        """COUNTS of each part for a filter that follows a set of others, given as bits."""
        gone = np.zeros_like(self.rows)
        for i, x in enumerate(self.fails):
            if first >> i & 1:
                gone |= x
        others = np.zeros_like(self.rows)
        for i, x in enumerate(self.fails):
            if i != then:
                others |= x
        fails = self.fails[then]
        removed = fails & ~gone
        return [self.count(x) for x in (self.rows & ~gone & ~fails, removed, fails & gone, fails & ~others, removed & self.good, removed & self.toxic)]


def counted(rows: DataFrame) -> DataFrame:
    """COUNTS by part, set of filters that come first (bits), and filter that follows."""
    combos = [(first, then) for first in range(1 << len(FILTERS)) for then in range(len(FILTERS)) if not first >> then & 1]

    def counts_of(table: pa.Table) -> pa.RecordBatch:
        part = table.column("part").combine_chunks().dictionary_encode()
        codes = part.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        maps = Bitmaps(codes, len(part.dictionary), *(table.column(c).to_numpy() for c in ("fails", "good", "toxic")))
        names, n = part.dictionary.take(pa.array(maps.parts)), len(maps.parts)
        each = [maps.after(*x) for x in combos]
        columns = [pa.concat_arrays([names] * len(combos)), np.repeat([x[0] for x in combos], n), np.repeat([x[1] for x in combos], n)]
        columns += [np.concatenate([x[i] for x in each]) for i in range(len(COUNTS))]
        return pa.RecordBatch.from_arrays([columns[0], *(pa.array(c.astype(np.int64)) for c in columns[1:])], ["part", "first", "then", *COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= PACKED_ROWS:
                yield counts_of(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield counts_of(pa.Table.from_batches(held))

    schema = "part string, first long, then long, " + ", ".join(f"{c} long" for c in COUNTS)
    return rows.mapInArrow(frugal(run), schema).groupBy("part", "first", "then").agg(*[F.sum(c).alias(c) for c in COUNTS])


def orders(sums: DataFrame) -> DataFrame:
    """A row for every part, order of the filters and step, with COUNTS and the filter's share of all orders' removals."""
    n = len(FILTERS)
    steps = []
    for order in permutations(range(n)):
        first = 0
        for step, then in enumerate(order):
            steps.append(("".join(FILTERS[i] for i in order), step + 1, first, then))
            first |= 1 << then
    table = sums.sparkSession.createDataFrame(steps, "filter_order string, step int, first long, then long")  # 600 rows
    ahead = F.bit_count("first")
    times = F.lit(0)  # how many orders put just these filters before this one
    for k in range(n):
        times = F.when(ahead == k, F.lit(math.factorial(k) * math.factorial(n - 1 - k))).otherwise(times)
    shapley = sums.groupBy("part", "then").agg(F.sum(F.col("removed") * times).alias("shapley"))
    out = sums.join(shapley, ["part", "then"]).join(F.broadcast(table), ["first", "then"])
    return out.select("part", "filter_order", "step", *COUNTS, "shapley")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every part, order and step, with its counts; texts are read once, into a work table of the filters' verdicts."""
    rows = materialize(failing(docs), "failures")
    return orders(counted(with_labels(with_copies(rows), labels)))
