"""SimHash fingerprints and near-duplicate links by tiled comparison.

Fingerprints: each bit is the majority of that bit over the XXH64 hashes of all word shingles. Equal fingerprints are one
node. Nodes are dealt to bands of their bits; within a band's value, rows are sorted by their population count and compared
tile by tile (exclusive-or and bit counts in numpy); a tile pair whose population counts differ by more than the radius is
skipped. A task hands on a spanning forest of what it finds, never all pairs. Band values with more rows than a block are
cut into blocks, and all pairs of blocks are compared in tasks of their own, so no group lands in one task. There are at
most as many such values as blocks, so their counts may go to the driver.

classes: 64 bits over SHINGLE words, repeats included. The bits are shared out to radius + m blocks, and every m of them are a
band: two that differ in at most radius bits agree on m blocks, so no link is lost, whatever m is. The more nodes there are,
the larger the m that costs least, as larger bands have fewer rows of a value and there are more of them.

keep_first: WIDE bits over WIDE_SHINGLE words, each shingle once, for texts that share SIMILARITY of their shingles or more.
Two texts of Jaccard likeness J differ in a bit with a chance of acos(2 J / (1 + J)) / pi; the radius is what SIMILARITY
gives, and SLACK standard deviations. As no few bands could promise an agreement at that radius, all distinct fingerprints are
compared: nodes are dealt to blocks of about BLOCK at most, each of them one packed row of a work table, and every block meets
every other in a Cartesian product that reads this table, so a node is shuffled once, however many blocks there are. The
comparisons grow as the square of the nodes; a tile looks at half of the words first, and at the others where these leave a
pair.

Defined results: null texts and texts without words have fingerprint zero, which links like any other; fewer words than
a shingle: the whole sequence; texts of any length are read whole; empty tables give no rows. classes: repeated rows each
give their row; a null doc_id never names a component unless it has no other. keep_first: one row of each group stays, that
of the smallest doc_id, where a null counts as larger than all others and ties are broken by a row's place in the work
table; repeated rows, and rows of one doc_id, are rows like others. Other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from .common import ROWS_AT_ONCE, WORD, ascii_lower, frugal, frugal_group, map_batches, materialize
from .graph import components, forest

SHINGLE, RADIUS, SEED, BITS = 4, 4, 42, 64
WIDE, WIDE_SHINGLE, SIMILARITY, SLACK = 256, 5, 0.8, 1.3
#: Nodes of a block, of which every pair is compared; rows and columns of a tile of such a pair; links that are held at once.
BLOCK, TILE_ROWS, TILE_COLUMNS, HELD_LINKS = 131_072, 128, 512, 1_000_000
#: Row numbers that may be broadcast.
MAX_BROADCAST = 4_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
TILE = 256
#: Rows that a task compares at once before it hands on its links, unless one group has more.
CHUNK = 65_536
LEAST_BLOCK = 512
#: Comparisons that a row of a band costs as much as.
ROW_COST = 64


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of every word shingle."""
    words = WORD.findall(ascii_lower(text or ""))
    if not words:
        return np.zeros(0, np.uint64)
    joined = " ".join(words).encode("utf-8", "surrogatepass")
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    k = min(shingle, len(words))
    starts, ends = np.concatenate(([0], gaps + 1)), np.append(gaps, len(joined))
    hashed = xxhash.xxh64_intdigest
    return np.array([hashed(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> np.ndarray:
    """The words of the fingerprint of rows of hashes, as many words in each row."""
    votes = np.zeros(64 * hashes.shape[1], np.int64)
    for begin in range(0, len(hashes), 1 << 14):
        part = np.ascontiguousarray(hashes[begin : begin + (1 << 14)])
        votes += np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    return int(majority(shingle_hashes(text, shingle)[:, None])[0])


def wide_fingerprint(text: str | None) -> np.ndarray:
    """WIDE bits, as words, over the distinct shingles; each hash gives all its words by mixing."""
    h = np.unique(shingle_hashes(text, WIDE_SHINGLE))
    words = [h]
    for k in range(1, WIDE // 64):
        x = (h ^ np.uint64(k)) * _MIX
        x = (x ^ (x >> np.uint64(29))) * _MIX
        words.append(x ^ (x >> np.uint64(32)))
    return majority(np.stack(words, axis=1))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every row of docs."""

    def make():
        def step(batch: dict) -> dict:
            fps = np.array([fingerprint(t, shingle) for t in batch["text"]], np.uint64).view(np.int64)
            return {"doc_id": batch["doc_id"], "fp": fps.tolist()}

        return step

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, fp long")


def tile_links(fps: np.ndarray, pops: np.ndarray, groups: np.ndarray, radius: int) -> np.ndarray:
    """Smallest row reachable from each row, over links within the same group. Rows are sorted by group and pops.

    fps has a row for each fingerprint, or is its only word.
    """
    fps = fps.astype(np.int64).view(np.uint64).reshape(len(fps), -1)  # bit counts of negative numbers are those of their absolute values
    n, a, b = len(fps), [], []
    for i in range(0, n, TILE):
        last = min(i + TILE, n) - 1
        for j in range(i, n, TILE):
            end = min(j + TILE, n)
            if groups[j] > groups[last] or (groups[i] == groups[end - 1] and pops[j] - pops[last] > radius and j > i):
                break
            differ = np.bitwise_count(fps[i : last + 1, None, 0] ^ fps[None, j:end, 0])
            if fps.shape[1] > 1:
                differ = differ.astype(np.uint16)
                for w in range(1, fps.shape[1]):
                    differ += np.bitwise_count(fps[i : last + 1, None, w] ^ fps[None, j:end, w])
            near = differ <= radius
            near &= groups[i : last + 1, None] == groups[None, j:end]
            x, y = np.nonzero(near)
            if j == i:
                x, y = x[x < y], y[x < y]
            if len(x) > 2 * TILE:  # only what keeps them connected
                low = forest(2 * TILE, x, y + TILE if j > i else y)
                y = np.flatnonzero(low != np.arange(len(low)))
                x = low[y]
                x, y = np.where(x >= TILE, j - TILE + x, i + x), np.where(y >= TILE, j - TILE + y, i + y)
            else:
                x, y = x + i, y + j
            a.append(x)
            b.append(y)
    return forest(n, np.concatenate(a), np.concatenate(b)) if a else np.arange(n)


def sharing_bands(radius: int, nodes: int = 0, most: int = 4) -> list[list[int]]:
    """Bands of a fingerprint of one word, of which two that differ in at most radius bits share one; see the module's text."""

    def bands(m: int) -> list[list[int]]:
        edges = np.linspace(0, BITS, radius + m + 1).astype(int).tolist()
        blocks = [list(range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
        return [sum(some, []) for some in combinations(blocks, m)]

    cost = lambda made: sum(ROW_COST + nodes / 2 ** len(b) for b in made)
    return min((bands(m) for m in range(1, most + 1)), key=cost)


def wide_radius() -> int:
    share = math.acos(2 * SIMILARITY / (1 + SIMILARITY)) / math.pi
    return int(WIDE * share + SLACK * math.sqrt(WIDE * share * (1 - share)))


def _band_value(words: list[str], number: int, band: list[int]):
    """The band's bits of the fingerprint behind the band's number."""
    out = F.lit(number).cast("long")
    runs = [[band[0], 0]] if band else []
    for bit in band:  # neighbouring bits of a word at once
        if bit == sum(runs[-1]) and bit % 64:
            runs[-1][1] += 1
        else:
            runs.append([bit, 1])
    for bit, n in (r for r in runs if r[1]):
        part = F.shiftrightunsigned(words[bit // 64], bit % 64)
        out = F.shiftleft(out, n).bitwiseOR(part.bitwiseAND(F.lit((1 << n) - 1)) if n < 64 else part)
    return out


def links(nodes: DataFrame, bands: list[list[int]], radius: int) -> DataFrame:
    """Links a, b between the nodes (columns node, and words w0, w1 ... of distinct fingerprints), enough to connect all that
    share a band and differ in at most radius bits."""
    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = [c for c in nodes.columns if c != "node"]
    rows = nodes.select("node", *words, F.explode(F.array(*[_band_value(words, k, band).cast("long") for k, band in enumerate(bands)])).alias("band"))
    counts = rows.groupBy("band").count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    block = max(LEAST_BLOCK, total // (4 * parts))
    hot = {r["band"]: -(-r["count"] // block) for r in counts.where(F.col("count") > block).collect()}  # at most total / block
    if hot:
        table = spark.createDataFrame(sorted(hot.items()), "band long, blocks int")  # as many rows at most
        rows = rows.join(F.broadcast(table), "band", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    else:
        rows = rows.withColumn("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pop = sum((F.bit_count(w) for w in words[1:]), F.bit_count(words[0]))
    rows = rows.select("node", *words, "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), pop.alias("pop"))
    dealt = rows.repartition(parts, "band", "i", "j").sortWithinPartitions("band", "i", "j", "pop")
    keys = ("band", "i", "j")
    names = dealt.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def found(held: dict[str, np.ndarray]) -> pa.RecordBatch:
            change = np.any([held[k][1:] != held[k][:-1] for k in keys], axis=0)
            fps = np.stack([held[w] for w in words], axis=1)
            low = tile_links(fps, held["pop"], np.concatenate(([0], np.cumsum(change))), radius)
            a, b = held["node"], held["node"][low]
            return pa.RecordBatch.from_pydict({"a": a[a != b], "b": b[a != b]}, schema=schema)

        held = {c: np.zeros(0, np.int64) for c in names}
        for batch in batches:
            held = {c: np.concatenate((x, batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64))) for c, x in held.items()}
            n = len(held["node"])
            if n >= CHUNK:
                same = np.all([held[k] == held[k][-1] for k in keys], axis=0)
                cut = n - int(np.argmin(same[::-1])) if not same.all() else 0
                if cut:
                    yield found({c: x[:cut] for c, x in held.items()})
                    held = {c: x[cut:] for c, x in held.items()}
        if len(held["node"]):
            yield found(held)

    return dealt.mapInArrow(frugal(run), "a long, b long")


def block_links(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the columns of left and those of right that differ in at most radius bits, enough to connect all of them.

    left, right: a row for each word, a column for each fingerprint. right's columns are numbered after left's; without right,
    left's columns are compared with each other.
    """
    other = left if right is None else right
    n, m, shift = left.shape[1], other.shape[1], 0 if right is None else left.shape[1]
    first = max(1, len(left) // 2)  # words that are looked at first
    bits, some, more = (np.empty((TILE_ROWS, TILE_COLUMNS), t) for t in (np.uint64, np.uint8, np.uint8))
    a, b, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for j in range(0, m, TILE_COLUMNS):
        end = min(j + TILE_COLUMNS, m)
        for i in range(0, min(n, end) if right is None else n, TILE_ROWS):
            last = min(i + TILE_ROWS, n)
            tile = np.s_[: last - i, : end - j]
            for w in range(first):
                np.bitwise_xor(left[w, i:last, None], other[w, None, j:end], out=bits[tile])
                np.bitwise_count(bits[tile], out=more[tile] if w else some[tile])
                if w:
                    some[tile] += more[tile]
            x, y = np.divmod(np.flatnonzero(some[tile] <= radius), end - j)
            x, y = x + i, y + j
            if right is None:
                x, y = x[x < y], y[x < y]
            if len(x):
                near = np.bitwise_count(left[:, x] ^ other[:, y]).sum(axis=0, dtype=np.int64) <= radius
                a.append(x[near])
                b.append(y[near] + shift)
                held += len(a[-1])
        if held > HELD_LINKS:  # only what keeps them connected
            low = forest(shift + m, np.concatenate(a), np.concatenate(b))
            y = np.flatnonzero(low != np.arange(len(low)))
            a, b, held = [low[y]], [y], 0
    return np.concatenate(a), np.concatenate(b)


def all_links(nodes: DataFrame, n: int, radius: int) -> DataFrame:
    """Links a, b between the n nodes (as for links), enough to connect all that differ in at most radius bits."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = ["node", *[c for c in nodes.columns if c != "node"]]
    # as many blocks as their size asks for, or as give each task some pairs of blocks
    blocks = max(-(-n // BLOCK), min(-(-n // LEAST_BLOCK), math.isqrt(8 * parts)), 1)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def pack(table: pa.Table) -> pa.Table:
        held = np.stack([table.column(c).to_numpy() for c in columns])
        return pa.table({"block": table.column("block")[:1], "packed": pa.array([held.tobytes()], pa.binary())})

    def unpack(value: pa.BinaryScalar) -> tuple[np.ndarray, np.ndarray]:
        held = np.frombuffer(value.as_buffer(), np.int64).reshape(len(columns), -1)
        return held[0], held[1:].view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                node, left = unpack(batch.column("left")[k])
                right = None
                if batch.column("i")[k] != batch.column("j")[k]:
                    more, right = unpack(batch.column("right")[k])
                    node = np.append(node, more)
                low = forest(len(node), *block_links(left, right, radius))
                b = np.flatnonzero(low != np.arange(len(low)))
                yield pa.RecordBatch.from_pydict({"a": node[low[b]], "b": node[b]}, schema=schema)

    own = F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("block")
    dealt = nodes.select(own, *columns).repartition(parts, "block")
    packed = materialize(dealt.groupBy("block").applyInArrow(frugal_group(pack), "block int, packed binary"), "blocks")
    left, right = (packed.select(F.col("block").alias(i), F.col("packed").alias(side)) for i, side in (("i", "left"), ("j", "right")))
    # a grid of blocks, which tasks read from the work table: nothing is sent once for each block that it meets
    return left.hint("shuffle_replicate_nl").join(right, F.col("i") <= F.col("j")).mapInArrow(frugal(run), "a long, b long")


def with_roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds root, the smallest node that links reach."""
    return nodes.join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))


def classes(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id of all that links reach) of every row of docs."""
    each = materialize(fingerprints(docs, shingle), "fingerprints")
    nodes = materialize(each.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    nodes = nodes.select(F.col("fp").alias("node"), F.col("fp").alias("w0"), "first")
    nodes = with_roots(nodes, links(nodes.select("node", "w0"), sharing_bands(radius, nodes.count()), radius))
    firsts = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    return each.join(nodes.join(firsts, "root").select(F.col("node").alias("fp"), "component_id"), "fp").select("doc_id", "fp", "component_id")


def _numbered(docs: DataFrame, row: str, words: list[str]) -> DataFrame:
    """The rows of docs with a row number and the words of their wide fingerprint, in a work table."""
    arrow = to_arrow_schema(StructType([StructField(w, LongType()) for w in words]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(begin, ROWS_AT_ONCE)
                fps = np.stack([wide_fingerprint(t) for t in part.column("text").to_pylist()]).view(np.int64)
                for k, field in enumerate(arrow):
                    part = part.append_column(field, pa.array(np.ascontiguousarray(fps[:, k])))
                yield part

    schema = StructType([*docs.schema.fields, *[StructField(w, LongType()) for w in words]])
    return materialize(docs.mapInArrow(frugal(run), schema).withColumn(row, F.monotonically_increasing_id()), "numbered")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs without those that are near-duplicates of an earlier one, with all their columns."""
    free = "_" * (1 + max(len(c) for c in docs.columns))
    row, words = f"{free}row", [f"{free}w{k}" for k in range(WIDE // 64)]
    written = _numbered(docs, row, words)
    each = written.select(F.col(row).alias("row"), F.col("doc_id"), *[F.col(w).alias(f"w{k}") for k, w in enumerate(words)])
    short = [f"w{k}" for k in range(len(words))]
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    nodes = materialize(each.groupBy(*short).agg(best.alias("best"), F.min("row").alias("node")), "nodes")
    rooted = with_roots(nodes, all_links(nodes.select("node", *short), nodes.count(), wide_radius()))
    stay = rooted.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias("row"))
    later = materialize(each.select("row").join(stay, "row", "left_anti").withColumnRenamed("row", row), "later")
    later = F.broadcast(later) if later.count() <= MAX_BROADCAST else later.hint("shuffle_merge")
    return written.join(later, row, "left_anti").select(*docs.columns)
