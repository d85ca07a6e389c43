"""Alignment of two tokenizers' tokens over the same bytes, by segment deduplication.

A: a byte-level BPE file of `tokenizers`; B: a BPE model of `sentencepiece`. A text with a space before it is cut before runs
of white space, at those characters of which both vocabularies say that no token holds them after another character that is
no white space (safe_breaks): nothing can merge across such a cut, and A's own pattern cuts there too. So the tokens of a text
are those of its segments, one after the other, and so are the groups and links, as both have a token's end at each cut.

Documents are put into blocks of about BLOCK_BYTES. A block has its distinct segments, and its documents as numbers of them. A
block's segments are dealt to buckets by a hash, as a row of segments for each bucket; in a bucket the rows of all blocks meet,
each distinct segment is tokenised and aligned once, and the alignments join back to the rows of the blocks: a block has a
segment once however often its documents do. The block's documents are then composed, and the block counts the documents that
have each pair of ids linked. These counts are added up over all blocks and come back to the links: to every task if they are
at most MOST_PAIRS, else by a join.

Defined results: texts that are null or empty, or whose joined tokens of A or B aren't the bytes of the text with the space
(a character U+2581 is the space of B), have no tokens: zeros and an empty digest. Strings of special tokens are plain text.
Texts of any length are aligned whole; a longer one than BLOCK_BYTES is a block by itself. Repeated rows, and rows with a null
doc_id, each give their row and count as documents of their own. Empty tables give no rows. Other columns are left out,
whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import frugal, frugal_group, kept, materialize

#: Bytes of texts in a block, and of those that a task cuts at once, about; bytes of input for each bucket.
BLOCK_BYTES, BYTES_AT_ONCE, BUCKET_BYTES = 24_000_000, 4_000_000, 8_000_000
#: Segments that are tokenised at once.
SEGMENTS_AT_ONCE = 20_000
#: Pairs of ids whose counts go to every task, at most.
MOST_PAIRS = 4_000_000
#: How work tables are written: a row of a block is large, so few go to a row group.
FILES = {"compression": "zstd", "parquet.block.size": str(16 << 20)}
# The characters that Unicode calls white space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
SPACE = "▁"


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it can be seen, else one from 256 on."""
    seen = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace()]
    rest = iter(range(256, 512))
    return [chr(b if b in seen else next(rest)) for b in range(256)]


class Tokenizers:
    """Both tokenizers, without anything put before a text, and the bytes of their tokens."""

    def __init__(self, a_json: str, b_model: bytes):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            # the special token is an entry too, but never comes out of a text
            self.a_bytes[i] = bytes(map(byte_of.__getitem__, token)) if all(c in byte_of for c in token) else b""
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(b_model)
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces or not proto.trainer_spec.byte_fallback:
            raise ValueError("only models with byte fallback, a dummy prefix and no normalisation are supported")
        norm.add_dummy_prefix = False  # texts come with their space
        self.b = SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.b_bytes = []
        for piece in proto.pieces:
            byte = re.fullmatch("<0x([0-9A-F]{2})>", piece.piece) if piece.type == 6 else None
            self.b_bytes.append(bytes([int(byte[1], 16)]) if byte else piece.piece.replace(SPACE, " ").encode() if piece.type == 1 else b"")
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.a_raw, self.b_raw = (np.frombuffer(b"".join(x), np.uint8) for x in (self.a_bytes, self.b_bytes))

    def safe_breaks(self) -> str:
        """ASCII white space before which a text can be cut: no token of A or B has it after what isn't white space."""
        texts = [x.decode("utf-8", "replace") for x in (*self.a_bytes, *self.b_bytes)]
        inside = {b for t in texts for a, b in zip(t, t[1:], strict=False) if a not in WHITE_SPACE and b in WHITE_SPACE}
        return "".join(c for c in WHITE_SPACE if c.isascii() and c not in inside)


def segment_pattern(breaks: str) -> re.Pattern:
    """Finds segments: each starts at a run of white space that begins with one of breaks, or where the text does."""
    gap = "".join(map("\\u{:04x}".format, map(ord, WHITE_SPACE)))
    other = "".join("\\u{:04x}".format(ord(c)) for c in WHITE_SPACE if c not in breaks)
    joined = f"(?:[{other}][{gap}]*[^{gap}]+)*" if other else ""
    tail = f"(?:[{other}][{gap}]*)?" if other else ""
    return re.compile(f"[{gap}]*[^{gap}]+{joined}{tail}|[{gap}]+")


def _places(sizes: np.ndarray) -> np.ndarray:
    """0 to size - 1 for each size, end to end."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _gather(flat: np.ndarray, sizes: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The parts of flat (of these sizes, end to end) with the given numbers, end to end."""
    starts, own = np.cumsum(sizes) - sizes, sizes[number]
    return flat[np.repeat(starts[number], own) + _places(own)]


def _lists(values: list[np.ndarray | list]) -> tuple[np.ndarray, np.ndarray]:
    """Lists end to end, and their sizes."""
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    return np.fromiter((x for v in values for x in v), np.int64, int(sizes.sum())), sizes


class Aligned(NamedTuple):
    """Of each segment: whether both tokenizers give its bytes back, and if so its counts and links in order.

    A link is its ids, and says whether its token of A is another one than that of the link before, its token of B, its group.
    """

    fits: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    links: np.ndarray
    fresh: np.ndarray


def _exact(ids: np.ndarray, owner: np.ndarray, sizes: np.ndarray, raw: np.ndarray, lengths: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Which segments (of these lengths, end to end in data) are the bytes of their tokens; owner: the segment of each token."""
    fits = np.bincount(owner, sizes[ids], len(lengths)).astype(np.int64) == lengths
    kept = fits[owner]
    said, own = _gather(raw, sizes, ids[kept]), np.repeat(np.arange(len(lengths)), np.where(fits, lengths, 0))
    fits[own[said != data[np.repeat(fits, lengths)]]] = False
    return fits


def aligned(tools: Tokenizers, segments: pa.Array) -> Aligned:
    """The alignments of segments, none of them empty."""
    words, n = segments.to_pylist(), len(segments)
    a_flat, a_count = _lists([x.ids for x in tools.a.encode_batch_fast(words, add_special_tokens=False)])
    b_flat, b_count = _lists(tools.b.encode(words, num_threads=1))
    lengths = pc.binary_length(segments).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer("".join(words).encode(), np.uint8)
    a_own, b_own = np.repeat(np.arange(n), a_count), np.repeat(np.arange(n), b_count)
    fits = _exact(a_flat, a_own, tools.a_sizes, tools.a_raw, lengths, data) & _exact(b_flat, b_own, tools.b_sizes, tools.b_raw, lengths, data)
    a_flat, a_own, b_flat, b_own = a_flat[fits[a_own]], a_own[fits[a_own]], b_flat[fits[b_own]], b_own[fits[b_own]]
    # all segments that fit lie end to end; both tokenizers have an end at the end of each
    a_size, b_size = tools.a_sizes[a_flat], tools.b_sizes[b_flat]
    a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
    cuts = a_end[np.isin(a_end, b_end, assume_unique=True)]
    # the tokens of B that end after a token of A starts, and start before it ends
    low = np.searchsorted(b_end, a_end - a_size, "right")
    width = np.searchsorted(b_end - b_size, a_end, "left") - low
    at_a, at_b, group = np.repeat(np.arange(len(a_flat)), width), np.repeat(low, width) + _places(width), np.repeat(np.searchsorted(cuts, a_end), width)
    fresh = sum((np.diff(x, prepend=-1) != 0).astype(np.uint8) << i for i, x in enumerate((at_a, at_b, group))).astype(np.uint8) if len(at_a) else np.zeros(0, np.uint8)
    each = lambda own, weight=None: np.bincount(own, weight, n).astype(np.int64)
    n_groups = each(a_own[np.searchsorted(a_end, cuts)])
    return Aligned(fits, each(a_own), each(b_own), n_groups, each(a_own, width), a_flat[at_a] << 32 | b_flat[at_b], fresh)


def group_texts(links: np.ndarray, fresh: np.ndarray, n_groups: np.ndarray) -> list[bytes]:
    """Groups as text of segments that lie end to end: ids of A by commas, |, ids of B by commas; groups by semicolons."""
    group = np.cumsum(fresh >> 2 & 1) - 1

    def said(ids: np.ndarray, new: np.ndarray) -> pa.Array:
        ends = np.cumsum(np.bincount(group[new], minlength=int(n_groups.sum())))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids[new]).cast(pa.string())), ",")

    each = pc.binary_join_element_wise(said(links >> 32, fresh & 1 == 1), said(links & 0xFFFFFFFF, fresh >> 1 & 1 == 1), "|")
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_groups)), pa.int32()), each), ";")
    return whole.cast(pa.binary()).to_pylist()


class _Cutter:
    """Cuts texts into segments, each with its number among all distinct ones so far."""

    def __init__(self, breaks: str):
        self.pattern, self.breaks = segment_pattern(breaks), np.zeros(256, bool)
        self.gap = np.zeros(256, bool)
        self.breaks[list(breaks.encode())] = True
        self.gap[[ord(c) for c in WHITE_SPACE if c.isascii()]] = True
        #: Texts with white space beyond ASCII are cut by the pattern.
        self.other = "[" + "".join(c for c in WHITE_SPACE if not c.isascii()) + "]"
        self.index: dict[str, int] = {}

    def cut(self, texts: pa.Array) -> list[np.ndarray]:
        """The numbers of each text's segments; none for an empty text."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
        number = lambda words: np.fromiter((self.index.setdefault(w, len(self.index)) for w in words), np.int64, len(words))
        slow = pc.match_substring_regex(texts, self.other).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(slow).tolist():
            out[i] = number(self.pattern.findall(" " + texts[i].as_py()))
        fast = np.flatnonzero(~slow & (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0))
        if len(fast):
            joined = pc.binary_join_element_wise("", texts.take(pa.array(fast)), " ").cast(pa.large_string())
            bounds = joined.offsets.to_numpy() if hasattr(joined, "offsets") else np.frombuffer(joined.buffers()[1], np.int64)[: len(joined) + 1]
            data = np.frombuffer(joined.buffers()[2], np.uint8)[: bounds[-1]]
            starts = self.breaks[data]
            starts[1:] &= ~self.gap[data[:-1]]
            starts[bounds[:-1]] = True
            at = np.flatnonzero(starts)
            words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data)).astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
            numbers = number(words.dictionary.to_pylist())[words.indices.to_numpy(zero_copy_only=False)]
            for i, part in zip(fast.tolist(), np.split(numbers, np.searchsorted(at, bounds[1:-1])), strict=True):
                out[i] = part
        return out


def _to_planes(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32 as their lowest bytes, the next ones, and so on, which compress better than the numbers."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1).astype(np.int64)
    return planes[0] | planes[1] << 8 | planes[2] << 16 | planes[3] << 24


def _packed(*parts: bytes) -> bytes:
    """Parts end to end, compressed, behind their sizes; a plain array column of each would take many times the room."""
    return np.array(list(map(len, parts)), "<u4").tobytes() + pa.compress(b"".join(parts), "zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> list[bytes]:
    sizes = np.frombuffer(data, "<u4", n).astype(np.int64)
    body, ends = pa.decompress(data[4 * n :], int(sizes.sum()), "zstd", asbytes=True) if sizes.sum() else b"", np.cumsum(sizes).tolist()
    return [body[b - k : b] for b, k in zip(ends, sizes.tolist(), strict=True)]


def _words(lengths: np.ndarray, data: bytes) -> pa.Array:
    """Strings that lie end to end."""
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(np.append(0, np.cumsum(lengths)).astype(np.int64)), pa.py_buffer(data))


#: packed: the places and lengths of some segments, and their bytes.
BLOCK = "block long, doc_id long, codes binary, bucket long, packed binary"


def blocks(docs: DataFrame, breaks: str, buckets: int) -> DataFrame:
    """Rows of blocks: a document has its segments as numbers (codes, in planes); a bucket has some segments and their numbers."""
    schema = to_arrow_schema(StructType.fromDDL(BLOCK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, cutter = TaskContext.get().partitionId() << 32, 0, _Cutter(breaks)

        def rows(**columns: list) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            values = {f.name: [None] * n for f in schema} | {"block": [block] * n} | columns
            return pa.RecordBatch.from_arrays([pa.array(values[f.name], f.type) for f in schema], schema=schema)

        def dealt() -> Iterator[pa.RecordBatch]:
            words = list(cutter.index)
            bucket = np.fromiter((zlib.crc32(w.encode()) % buckets for w in words), np.int64, len(words))
            order = np.argsort(bucket, kind="stable")
            for place in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                if len(place):
                    own = [words[i].encode() for i in place.tolist()]
                    lengths = np.fromiter(map(len, own), np.int64, len(own))
                    yield rows(bucket=[bucket[place[0]]], packed=[_packed(_to_planes(place), _to_planes(lengths), b"".join(own))])

        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            begin = 0
            while begin < batch.num_rows:
                done = int(sizes[begin - 1]) if begin else 0
                end = max(int(np.searchsorted(sizes, done + min(BYTES_AT_ONCE, BLOCK_BYTES), "right")), begin + 1)
                part, begin = batch.slice(begin, end - begin), end
                if held and held + int(sizes[end - 1]) - done > BLOCK_BYTES:
                    yield from dealt()
                    block, held, cutter = block + 1, 0, _Cutter(breaks)
                held += int(sizes[end - 1]) - done
                codes = cutter.cut(pc.fill_null(part.column("text"), ""))
                yield rows(doc_id=part.column("doc_id").to_pylist(), codes=list(map(_to_planes, codes)))
        yield from dealt()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(run), BLOCK)


def tools_of(a_json: str, b_model: bytes) -> Tokenizers:
    """One pair of tokenizers a Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return kept("tokenizers", (hash(a_json), hash(b_model)), lambda: Tokenizers(a_json, b_model))


#: packed: places, fits, the four SUMS, and of all links the ids of A, those of B, and what is fresh.
ALIGNED = "in_block long, packed binary"
SUMS = ("n_a", "n_b", "n_groups", "n_links")


def aligned_buckets(dealt: DataFrame, a_json: str, b_model: bytes) -> DataFrame:
    """For every row of segments (block, bucket, packed) their alignments; in a bucket each distinct segment is aligned once."""
    schema = to_arrow_schema(StructType.fromDDL(ALIGNED))

    def align_bucket(table: pa.Table) -> pa.Table:
        tools = tools_of(a_json, b_model)
        rows = [_unpacked(x.as_py(), 3) for x in table.column("packed")]
        sizes = [len(r[1]) // 4 for r in rows]
        words = _words(np.concatenate([_from_planes(r[1]) for r in rows]), b"".join(r[2] for r in rows)).dictionary_encode()
        distinct = words.dictionary.cast(pa.string())
        parts = [aligned(tools, distinct.slice(i, SEGMENTS_AT_ONCE)) for i in range(0, len(distinct), SEGMENTS_AT_ONCE)]
        fits, *sums, links, fresh = (np.concatenate([p[i] for p in parts]) for i in range(7))
        out = []
        for row, at in zip(rows, np.split(words.indices.to_numpy(zero_copy_only=False), np.cumsum(sizes)[:-1]), strict=True):
            own = _gather(links, sums[3], at)
            numbers = [_to_planes(x[at]) for x in sums]
            out.append(_packed(row[0], fits[at].astype(np.uint8).tobytes(), *numbers, _to_planes(own >> 32), _to_planes(own & 0xFFFFFFFF), _gather(fresh, sums[3], at).tobytes()))
        return pa.Table.from_arrays([table.column("block").combine_chunks(), pa.array(out, pa.binary())], schema=schema)

    return dealt.groupBy("bucket").applyInArrow(frugal_group(align_bucket, "tokenizers"), ALIGNED)


class _Segments:
    """The alignments of a block's segments, by place."""

    def __init__(self, rows: list[bytes]):
        parts = [_unpacked(r, 9) for r in rows]
        column = lambda i: np.concatenate([_from_planes(p[i]) for p in parts]) if parts else np.zeros(0, np.int64)
        order = np.argsort(column(0))
        self.fits = np.frombuffer(b"".join(p[1] for p in parts), np.uint8)[order] > 0
        unsorted = column(5)
        self.sums = [column(i)[order] for i in (2, 3, 4, 5)]
        self.links = _gather(column(6) << 32 | column(7), unsorted, order)
        fresh = np.frombuffer(b"".join(p[8] for p in parts), np.uint8)
        self.groups = group_texts(self.links, _gather(fresh, unsorted, order), self.sums[2])


COMPOSED = "block long, doc_ids array<long>, codes binary, bounds array<int>, " + ", ".join(f"{c} array<long>" for c in SUMS) + ", digests array<string>, links binary, pairs array<long>, n_docs array<long>"


def composed(documents: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each block: its documents' sums and digests, the links of its segments, and its number of documents for each pair."""
    schema = to_arrow_schema(StructType.fromDDL(COMPOSED))

    def compose(block: pa.Table, own: pa.Table) -> pa.Table:
        if not block.num_rows:
            return schema.empty_table()
        parts = [_from_planes(x.as_py()) for x in block.column("codes")]
        codes, bounds = np.concatenate(parts), np.append(0, np.cumsum(list(map(len, parts))))
        found = _Segments(own.column("packed").to_pylist())
        sizes, groups = found.sums[3], found.groups
        misses = np.append(0, np.cumsum(~found.fits[codes]))[bounds]
        usable = (np.diff(bounds) > 0) & (misses[1:] == misses[:-1])
        totals = [np.diff(np.append(0, np.cumsum(x[codes]))[bounds]) * usable for x in found.sums]
        start = np.cumsum(sizes) - sizes
        pairs, local = np.unique(found.links, return_inverse=True)
        n_docs, digests = np.zeros(len(pairs), np.int64), [""] * block.num_rows
        for at in np.flatnonzero(usable).tolist():
            mine = codes[bounds[at] : bounds[at + 1]]
            digests[at] = hashlib.sha256(b";".join(map(groups.__getitem__, mine.tolist()))).hexdigest()
            mine = np.unique(mine)
            n = sizes[mine]
            n_docs[np.unique(local[np.repeat(start[mine], n) + _places(n)])] += 1
        seen = np.flatnonzero(n_docs)
        row = [block.column("block")[0].as_py(), block.column("doc_id").to_pylist(), _packed(_to_planes(codes)), bounds, *totals, digests, _packed(_to_planes(sizes), _to_planes(found.links >> 32), _to_planes(found.links & 0xFFFFFFFF)), pairs[seen], n_docs[seen]]
        return pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        return frugal_group(lambda _: compose(left, right))(left)

    return documents.groupBy("block").cogroup(found.groupBy("in_block")).applyInArrow(both, COMPOSED)


def _sizes_and_links(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    sizes, a, b = map(_from_planes, _unpacked(data, 3))
    return sizes, a << 32 | b


def _links(table: DataFrame) -> DataFrame:
    """Block (of), place among its links (at) and pair of every link of every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("links").to_pylist(), strict=True):
                links = _sizes_and_links(data)[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(links), block)), pa.array(np.arange(len(links), dtype=np.int32)), pa.array(links)], ["of", "at", "pair"])

    return table.select("block", "links").mapInArrow(frugal(run), "of long, at int, pair long")


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def counted(table: DataFrame, scored: DataFrame) -> DataFrame:
    """The result's rows from those of the blocks; scored: pair, n_docs and is_best of all pairs."""
    known = None
    if scored.count() <= MOST_PAIRS:
        got = scored.select("pair", "n_docs", "is_best").toArrow()
        pair, n, best = (got.column(c).to_numpy() for c in ("pair", "n_docs", "is_best"))
        order = np.argsort(pair)
        known = pair[order], n[order], best[order]
    else:  # each link of a block gets its pair's count by a join; a block's links are few
        each = _links(table).join(scored, "pair", "left")
        each = each.select("of", "at", F.coalesce("n_docs", F.lit(0).cast("long")).alias("n_docs"), F.coalesce("is_best", F.lit(False)).alias("is_best")).groupBy("of").agg(F.sort_array(F.collect_list(F.struct("at", "n_docs", "is_best"))).alias("own"))
        table = table.join(each, F.col("block") == F.col("of"), "left").withColumns({"link_docs": F.col("own.n_docs"), "link_best": F.col("own.is_best")}).drop("of", "own")
    schema = to_arrow_schema(StructType.fromDDL(RESULT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                codes, bounds = _from_planes(_unpacked(row["codes"].as_py(), 1)[0]), row["bounds"].values.to_numpy()
                sizes, links = _sizes_and_links(row["links"].as_py())
                if known is None:
                    n, best = (row[c].values.to_numpy(zero_copy_only=False) if row[c].is_valid else np.zeros(0, np.int64) for c in ("link_docs", "link_best"))
                else:
                    at = np.minimum(np.searchsorted(known[0], links), max(len(known[0]) - 1, 0))
                    hit = known[0][at] == links if len(known[0]) else np.zeros(len(links), bool)  # links of unusable documents alone have no count
                    n, best = (np.where(hit, known[1][at], 0), hit & known[2][at]) if len(known[0]) else (hit * 0, hit)
                ends = np.cumsum(sizes)
                usable = row["n_a"].values.to_numpy() > 0

                def per_document(values: np.ndarray, ends=ends, sizes=sizes, codes=codes, bounds=bounds, usable=usable) -> np.ndarray:
                    total = np.append(0, np.cumsum(values.astype(np.int64)))
                    return np.diff(np.append(0, np.cumsum((total[ends] - total[ends - sizes])[codes]))[bounds]) * usable

                columns = [row["doc_ids"].values, *(row[c].values for c in SUMS), pa.array(per_document(best)), pa.array(per_document(n)), row["digests"].values]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return table.drop("pairs", "n_docs").mapInArrow(frugal(run), RESULT)


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, SUMS, n_best, count_sum and groups_sha256 of every row of docs."""
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        a_json, b_model = a.read(), b.read()
    size = int(docs.select("text")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())  # of the files, without reading them
    buckets = min(max(-(-size // BUCKET_BYTES), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 1 << 31)
    written = materialize(blocks(docs, tools_of(a_json, b_model).safe_breaks(), buckets), "blocks", FILES)
    documents = written.where("codes is not null").select("block", "doc_id", "codes")
    found = aligned_buckets(written.where("bucket is not null").select("block", "bucket", "packed"), a_json, b_model)
    table = materialize(composed(documents, found), "composed", FILES)
    counts = table.select(F.explode(F.arrays_zip("pairs", "n_docs")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.n_docs").alias("n_docs"))
    best = F.max("n_docs").over(Window.partitionBy(F.shiftright("pair", 32)))  # a token of A meets at most all of B
    return counted(table, materialize(counts.withColumn("is_best", F.col("n_docs") == best), "pairs"))
