"""Removal of repeated passages by a distributed merge sort of suffixes.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller doc_id.

Which suffixes are sorted: every window of LENGTH bytes has one anchor, the place of its smallest hash of GRAM bytes
(the first one of ties). Equal windows have equal anchors at equal places, so it's enough to sort the suffixes at anchors,
each with the bytes before it that its windows need: about a sixteenth of all suffixes, and no repeat is lost.

 1. Documents are packed into runs of RUN_BYTES, a row each, in a table bucketed by run; texts are never shuffled.
 2. Each run sends its anchors' hashes, sorted and delta-coded; a hash that two documents have marks its anchors. Hashes
    with more than HOT different surroundings are marked as hot.
 3. Each run sorts the suffixes at marked anchors, keeps one of equal ones (that of the smallest doc_id), and sends them
    front-coded: the length of the prefix shared with the one before, and the rest. Of a hot anchor it sends the windows
    themselves, each to the task of its own bytes, so that no task gets all surroundings of a common passage.
 4. A task merges the sorted runs of its part with a loser tree that knows how many bytes each head shares with the last
    output, and compares on only from there. Two windows are equal if the suffixes at their anchors share as many bytes as
    they have from the anchor on, as the merge tells, and the bytes before the anchors, sorted backwards, share the others.
    Equal windows so find their smallest doc_id.
 5. Each run hears which windows go, and cuts them from its texts.

Hashes only choose places and bring candidates together; which windows are equal is decided by shared bytes alone.

Defined results: null texts are empty; a null doc_id counts as larger than all others; rows of equal doc_id never remove
from one another; texts under LENGTH bytes lose nothing; texts of any length are one row of a run, whole; characters of
which only some bytes go are dropped from the text that is left; empty tables give no rows; other columns stay as they are,
whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import frugal, frugal_group, give_back, materialize, work_dir

LENGTH, GRAM = 50, 20
SPAN = LENGTH - GRAM
RUN_BYTES, RUN_DOCS = 3_000_000, 4_000
#: Different surroundings of an anchor from which on its windows are sorted by themselves, and runs that a part is made for.
HOT, RUNS_A_PART = 5_000, 32
#: Places of a run whose hashes are made at once.
PLACES_AT_ONCE = 1 << 17
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LAST = np.iinfo(np.int64).max


def _zip(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True) if data else b""


def _unzip(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True) if data else b""


def _planes(values: np.ndarray) -> bytes:
    """The bytes of equal weight of all values together."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _unplanes(data: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on."""
    n = len(data)
    h, four = (data.astype(np.uint64) + np.uint64(1)) * _MIX, None
    for k in (1, 2, 4, 8):  # hashes of 2, 4, 8 and 16 bytes
        h = h[: n - 2 * k + 1] * (_MIX + np.uint64(4 * k)) + h[k : n - k + 1]
        four = h if k == 2 else four
    gram = h[: n - GRAM + 1] * (_MIX + np.uint64(2)) + four[16:]
    gram ^= gram >> np.uint64(31)
    gram *= _MIX
    return gram


def _sliding_min(least: np.ndarray) -> np.ndarray:
    """The smallest of each SPAN + 1 neighbours."""
    reach = 1
    while 2 * reach <= SPAN + 1:
        least = np.minimum(least[: len(least) - reach], least[reach:])
        reach *= 2
    if rest := SPAN + 1 - reach:
        least = np.minimum(least[: len(least) - rest], least[rest:])
    return least


class Run:
    """Documents of a run: their bytes end to end, and the anchors of all windows."""

    def __init__(self, table: pa.Table):
        self.table = table
        texts = pc.fill_null(table["text"], "").combine_chunks()
        texts = (texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts).cast(pa.large_string())
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        self.bytes = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
        self.starts, self.ends = bounds[:-1] - bounds[0], bounds[1:] - bounds[0]
        self.ids = pc.fill_null(table["doc_id"], _LAST).to_numpy().astype(np.int64)
        self._anchors()

    def _anchors(self) -> None:
        n = len(self.bytes)
        sizes = np.maximum(self.ends - self.starts - LENGTH + 1, 0)
        if n < LENGTH or not sizes.sum():
            self.places = self.first = self.last = self.doc = np.zeros(0, np.int64)
            self.grams = self.around = self.gram = np.zeros(0, np.uint64)
            return
        small = np.int32 if n < 1 << 30 else np.int64
        gram, least = np.empty(n - GRAM + 1, np.uint64), np.empty(n - LENGTH + 1, small)
        for begin in range(0, len(gram), PLACES_AT_ONCE):
            gram[begin : begin + PLACES_AT_ONCE] = _gram_hashes(self.bytes[begin : begin + PLACES_AT_ONCE + GRAM - 1])
        low = (np.uint64(1) << np.uint64(n.bit_length())) - np.uint64(1)
        for begin in range(0, len(least), PLACES_AT_ONCE):
            part = gram[begin : begin + PLACES_AT_ONCE + SPAN]
            least[begin : begin + PLACES_AT_ONCE] = (_sliding_min((part & ~low) | np.arange(begin, begin + len(part), dtype=np.uint64)) & low).astype(small)
        doc = np.repeat(np.arange(len(sizes), dtype=small), sizes)
        window = np.repeat((self.starts - (np.cumsum(sizes) - sizes)).astype(small), sizes)
        window += np.arange(len(window), dtype=small)
        owner = least[window]
        del least
        fresh = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (doc[1:] != doc[:-1]))))
        self.places, self.doc = owner[fresh].astype(np.int64), doc[fresh].astype(np.int64)
        self.first, self.last = window[fresh].astype(np.int64), window[np.append(fresh[1:], len(owner)) - 1].astype(np.int64)
        self.gram, self.grams = gram, gram[self.places] >> np.uint64(24)
        self.around = self._window_hash(self.first) ^ (self._window_hash(self.last) * _MIX)

    def _window_hash(self, begin: np.ndarray) -> np.ndarray:
        return (self.gram[begin] * (_MIX + np.uint64(2))) ^ self.gram[begin + SPAN]

    def hashes(self, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes by part and value, their parts, the anchors' places among them, which two documents have, and in how
        many different surroundings."""
        order = np.lexsort((self.around, self.grams, self.grams % np.uint64(parts)))
        g, around = self.grams[order], self.around[order]
        fresh = np.concatenate(([True], g[1:] != g[:-1])) if len(g) else np.zeros(0, bool)
        other = fresh | np.concatenate(([True], around[1:] != around[:-1])) if len(g) else fresh
        back = np.empty(len(g), np.int64)
        back[order] = np.cumsum(fresh) - 1
        distinct = g[fresh]
        ids = self.ids[self.doc]
        low, high = np.full(len(distinct), _LAST), np.full(len(distinct), -_LAST)
        np.minimum.at(low, back, ids)
        np.maximum.at(high, back, ids)
        times = np.add.reduceat(other.astype(np.int64), np.flatnonzero(fresh)) if len(g) else np.zeros(0, np.int64)
        return distinct, (distinct % np.uint64(parts)).astype(np.int64), back, low < high, times

    def suffixes(self, marked: np.ndarray, hot: np.ndarray, parts: int) -> dict:
        """Sorted distinct suffixes at the marked anchors, with the bytes before them, and which anchors they stand for.

        Of a hot anchor each window is such a suffix, with nothing before it; their parts are numbered from `parts` on.
        """
        at, wide = np.flatnonzero(marked & ~hot), np.flatnonzero(marked & hot)
        sizes = self.last[wide] - self.first[wide] + 1
        alone = np.repeat(self.first[wide] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        p, first, last = (np.concatenate((x[at], alone)) for x in (self.places, self.first, self.last))
        doc = np.concatenate((self.doc[at], np.repeat(self.doc[wide], sizes)))
        part = np.concatenate((self.grams[at] % np.uint64(parts), np.uint64(parts) + (self._window_hash(alone) >> np.uint64(24)) % np.uint64(parts))).astype(np.int64)
        at = np.arange(len(p))
        right_len, left_len = LENGTH - (p - last), p - first
        padded = np.concatenate((np.zeros(SPAN, np.uint8), self.bytes, np.zeros(LENGTH, np.uint8)))
        # wide enough for whole 8-byte words
        right, left = np.zeros((len(at), 56), np.uint8), np.zeros((len(at), 32), np.uint8)
        if len(at):
            view = np.lib.stride_tricks.sliding_window_view(padded, SPAN + LENGTH)[p]
            right[:, :LENGTH] = np.where(np.arange(LENGTH) < right_len[:, None], view[:, SPAN:], 0)
            left[:, :SPAN] = np.where(np.arange(SPAN) >= SPAN - left_len[:, None], view[:, :SPAN], 0)
        keys = [left_len, *left.view(">u8").T[::-1], right_len, *right.view(">u8").T[::-1], part]
        order = np.lexsort(keys)
        fresh = np.zeros(len(order), bool)
        if len(order):
            fresh[0] = True
        for k in keys:
            k = k[order]
            fresh[1:] |= k[1:] != k[:-1]
        group = np.cumsum(fresh) - 1
        lead = np.flatnonzero(fresh)
        ids = self.ids[doc]
        low = np.minimum.reduceat(ids[order], lead) if len(lead) else ids
        back = np.empty(len(order), np.int64)
        back[order] = group
        top = order[lead]
        return {"place": p, "first": first, "last": last, "own": ids, "back": back, "ids": low, "part": part[top], "right": right[top, :LENGTH], "left": left[top, :SPAN], "right_len": right_len[top], "left_len": left_len[top]}


def front_code(s: dict, own: np.ndarray) -> bytes:
    """The suffixes of the given places: shared lengths, lengths, ids and left bytes, and what follows the shared ones."""
    right, n = s["right"][own], s["right_len"][own]
    shared = np.zeros(len(own), np.int64)
    if len(own) > 1:
        differ = np.concatenate((right[1:] != right[:-1], np.ones((len(own) - 1, 1), bool)), axis=1)
        shared[1:] = np.minimum(differ.argmax(axis=1), np.minimum(n[1:], n[:-1]))
    column = np.arange(LENGTH)
    rest = right[(column >= shared[:, None]) & (column < n[:, None])].tobytes()
    left = s["left"][own][np.arange(SPAN) >= SPAN - s["left_len"][own][:, None]].tobytes()
    head = np.stack((shared, n, s["left_len"][own])).astype(np.uint8).tobytes()
    return _zip(len(own).to_bytes(4, "little") + head + _planes(s["ids"][own].astype("<i8")) + len(rest).to_bytes(4, "little") + rest + left)


def front_decode(data: bytes) -> tuple[list[bytes], list[int], np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Suffixes, their shared lengths, ids, left bytes, and the lengths of both."""
    data = _unzip(data)
    n = int.from_bytes(data[:4], "little")
    head = np.frombuffer(data[4 : 4 + 3 * n], np.uint8).reshape(3, n).astype(np.int64)
    ids = _unplanes(data[4 + 3 * n : 4 + 11 * n], "<i8")
    at = 4 + 11 * n
    rest = data[at + 4 : at + 4 + int.from_bytes(data[at : at + 4], "little")]
    left = data[at + 4 + len(rest) :]
    suffixes, before, begin = [], b"", 0
    for shared, size in zip(head[0].tolist(), head[1].tolist(), strict=True):
        end = begin + size - shared
        before = before[:shared] + rest[begin:end]
        suffixes.append(before)
        begin = end
    ends = np.cumsum(head[2]).tolist()
    return suffixes, head[0].tolist(), ids, [left[a:b] for a, b in zip([0, *ends], ends)], head[1], head[2]


def merge(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int], list[int]]:
    """Merges sorted runs (strings, and how many bytes each shares with the one before in its run).

    Gives run, place and the number of bytes shared with the output before. A loser stays at its node with the number of
    bytes that it shares with the winner that passed; of two heads the one that shares more with the last output is
    smaller, and only equal numbers call for a comparison, which starts behind the shared bytes.
    """
    k = len(runs)
    size = 1 << max(k - 1, 0).bit_length()
    heads = [r[0][0] if r[0] else b"" for r in runs] + [b""] * (size - k)
    shares = [0 if r[0] else -1 for r in runs] + [-1] * (size - k)
    places, losers, known = [0] * k, [0] * size, [-1] * size

    def differ(a: bytes, b: bytes, h: int) -> int:
        """Up to where both are equal, known to be so up to h."""
        n = min(len(a), len(b))
        x = int.from_bytes(a[h:n], "big") ^ int.from_bytes(b[h:n], "big")
        return n if not x else n - (x.bit_length() + 7) // 8

    def play(node: int) -> tuple[int, int]:
        if node >= size:
            return node - size, shares[node - size]
        (s, h), (t, g) = play(2 * node), play(2 * node + 1)
        if g > h:
            s, h, t, g = t, g, s, h
        elif g == h and h >= 0:
            n = differ(heads[s], heads[t], h)
            if heads[t][n:] < heads[s][n:]:
                s, h, t, g = t, g, s, h
            g = n
        losers[node], known[node] = t, g
        return s, h

    s, h = play(1) if size > 1 else (0, shares[0])
    out_run, out_place, out_shared = [], [], []
    while h >= 0:
        at = places[s]
        out_run.append(s)
        out_place.append(at)
        out_shared.append(h)
        strings, shared = runs[s]
        at += 1
        places[s] = at
        if at < len(strings):
            h, heads[s] = shared[at], strings[at]
        else:
            h = -1
        node = (size + s) >> 1
        while node:
            g = known[node]
            if g > h:
                losers[node], known[node], s, h = s, h, losers[node], g
            elif g == h and h >= 0:
                t = losers[node]
                a, b = heads[s], heads[t]
                n = differ(a, b, h)
                if b[n : n + 1] < a[n : n + 1]:
                    losers[node], s = s, t
                known[node] = n
            node >>= 1
    return out_run, out_place, out_shared


def window_flags(shared: np.ndarray, left: np.ndarray, right_len: np.ndarray, left_len: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """A bit for each distance of a window's start before its anchor, set if a smaller id has the window.

    The suffixes come in their order; shared says how many bytes from the anchor on each shares with the one before, left has
    the bytes before the anchor. Equal windows at a distance lie between two places that share too little, and so they do in
    the order of the bytes before the anchors, read backwards.
    """
    n = len(ids)
    back = np.zeros((n, 32), np.uint8)
    back[:, :SPAN] = left[:, ::-1]
    order = np.lexsort(back.view(">u8").T[::-1])
    before = back[order]
    differ = np.concatenate((before[1:] != before[:-1], np.ones((max(n - 1, 0), 1), bool)), axis=1)
    common = np.concatenate(([0], differ.argmax(axis=1))) if n else np.zeros(0, np.int64)
    flags, left_class = np.zeros(n, np.uint32), np.empty(n, np.int64)
    for o in range(SPAN + 1):
        own = np.flatnonzero((LENGTH - right_len <= o) & (o <= left_len))
        if len(own) < 2:
            continue
        left_class[order] = np.cumsum(common < o)
        key = (np.cumsum(shared < LENGTH - o) * (n + 1) + left_class)[own]
        place = np.argsort(key, kind="stable")
        k, at = key[place], own[place]
        lead = np.concatenate(([True], k[1:] != k[:-1]))
        low = np.minimum.reduceat(ids[at], np.flatnonzero(lead))[np.cumsum(lead) - 1]
        flags[at[ids[at] > low]] |= np.uint32(1 << o)
    return flags


def merge_part(blobs: list[bytes], hot: bool = False) -> list[np.ndarray]:
    """For each run's suffixes the flags of their windows. Suffixes of a hot part are windows."""
    runs = [front_decode(b) for b in blobs]
    out = [np.zeros(len(r[0]), np.uint32) for r in runs]
    run, place, shared = (np.array(x, np.int64) for x in merge([(r[0], r[1]) for r in runs]))
    group = np.cumsum(shared < (LENGTH if hot else GRAM))
    begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.zeros(0, np.int64)
    alone = np.repeat(np.diff(np.append(begin, len(group))) < 2, np.diff(np.append(begin, len(group))))
    keep = np.flatnonzero(~alone)
    at = 0
    while at < len(keep):  # about 50,000 suffixes at once, whole groups; a group has at most about HOT, or one of each run
        end = min(at + 50_000, len(keep))
        while end < len(keep) and group[keep[end]] == group[keep[end - 1]]:
            end += 1
        own = keep[at:end]
        pairs = list(zip(run[own].tolist(), place[own].tolist(), strict=True))
        left = np.frombuffer(b"".join(runs[r][3][i].rjust(SPAN, b"\0") for r, i in pairs), np.uint8).reshape(-1, SPAN)
        numbers = [np.array([runs[r][k][i] for r, i in pairs], np.int64) for k in (4, 5, 2)]
        fresh = np.concatenate(([True], np.diff(group[own]) > 0))
        flags = window_flags(np.where(fresh, 0, shared[own]), left, *numbers)
        for (r, i), f in zip(pairs, flags.tolist(), strict=True):
            out[r][i] = f
        at = end
    return out


def _cut(run: Run, marks: dict[int, tuple[bytes, bytes]], flags: dict[int, bytes], parts: int) -> np.ndarray:
    """Which bytes of the run go."""
    s = _marked(run, marks, parts)
    gone = np.zeros(len(run.bytes) + 1, np.int32)
    local = s["own"] > s["ids"][s["back"]]
    np.add.at(gone, s["first"][local], 1)
    np.add.at(gone, s["last"][local] + LENGTH, -1)
    told = np.zeros(len(s["ids"]), np.uint32)
    bounds = np.searchsorted(s["part"], np.arange(2 * parts + 1))
    for part, data in flags.items():
        told[bounds[part] : bounds[part + 1]] = _unplanes(_unzip(data), "<u4")
    mine = told[s["back"]]
    for o in range(SPAN + 1):
        hit = s["place"][~local & ((mine >> np.uint32(o)) & np.uint32(1) > 0)] - o
        np.add.at(gone, hit, 1)
        np.add.at(gone, hit + LENGTH, -1)
    np.cumsum(gone, out=gone)
    return gone[:-1] > 0


def _before(flags: np.ndarray) -> np.ndarray:
    """How many flags are set before each place, and before the end."""
    out = np.zeros(len(flags) + 1, np.int32 if len(flags) < 1 << 30 else np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def _marked(run: Run, marks: dict[int, tuple[bytes, bytes]], parts: int) -> dict:
    distinct, part, back, *_ = run.hashes(parts)
    bounds = np.searchsorted(part, np.arange(parts + 1))
    hit, hot = np.zeros(len(distinct), bool), np.zeros(len(distinct), bool)
    for p, both in marks.items():
        for into, bits in zip((hit, hot), both, strict=True):
            if bits:
                a, b = bounds[p], bounds[p + 1]
                into[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
    return run.suffixes(hit[back], hot[back], parts)


def _read(blob: bytes) -> pa.Table:
    with pa.ipc.open_stream(_unzip(blob)) as reader:
        return reader.read_all()


def _runs(docs: DataFrame, buckets: int) -> DataFrame:
    """A row for each run of documents, all columns in one value, in a table bucketed by run."""
    arrow = to_arrow_schema(docs.schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def row() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as writer:
                for b in held:
                    writer.write_batch(b)
            return pa.RecordBatch.from_pydict({"run": [number], "blob": [_zip(sink.getvalue().to_pybytes())]}, schema=pa.schema([("run", pa.int64()), ("blob", pa.binary())]))

        for batch in batches:
            for begin in range(0, batch.num_rows, 200):
                part = batch.slice(begin, 200)
                held.append(part)
                size += pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
                if size >= RUN_BYTES or sum(b.num_rows for b in held) >= RUN_DOCS:
                    yield row()
                    number, held, size = number + 1, [], 0
        if held:
            yield row()

    assert "doc_id" in arrow.names and "text" in arrow.names
    name = f"granary_runs_{uuid.uuid4().hex}"
    spark = docs.sparkSession
    docs.mapInArrow(frugal(pack), "run long, blob binary").write.bucketBy(buckets, "run").option("path", f"{work_dir(spark)}/granary/{name}").saveAsTable(name)
    runs = spark.table(name)
    spark.sql(f"drop table {name}")  # its files stay, and so do its buckets in the plan
    return runs


def _over_runs(runs: DataFrame, told: DataFrame, step: Callable[[pa.Table, pa.Table], pa.Table], schema) -> DataFrame:
    """Applies step to each run's row and what it has been told."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return step(_read(left["blob"][0].as_py()), right)
        finally:
            give_back()

    return runs.groupBy("run").cogroup(told.groupBy("run")).applyInArrow(both, schema)


def cut_passages(docs: DataFrame, digest: bool = False) -> DataFrame:
    """The rows of docs without repeated passages, or only digests of what is left."""
    spark = docs.sparkSession
    if digest:
        docs = docs.select("doc_id", "text")
    workers = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = _runs(docs, workers)
    parts = max(4 * workers, runs.count() // RUNS_A_PART)

    def send_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column("run").to_pylist(), batch.column("blob"), strict=True):
                give_back()  # of the run before
                distinct, part, _, twice, times = Run(_read(blob.as_py())).hashes(parts)
                bounds = np.searchsorted(part, np.arange(parts + 1))
                rows = [(p, distinct[a:b], twice[a:b], times[a:b]) for p, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) if b > a]
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": [r[0] for r in rows],
                        "run": [number] * len(rows),
                        "hashes": [_zip(_planes(np.diff(r[1], prepend=np.uint64(0)).astype("<u8"))) for r in rows],
                        "twice": [np.packbits(r[2]).tobytes() for r in rows],
                        "times": [_zip(_planes(r[3].astype("<u4"))) for r in rows],
                    },
                    schema=pa.schema([("part", pa.int32()), ("run", pa.int64()), ("hashes", pa.binary()), ("twice", pa.binary()), ("times", pa.binary())]),
                )

    def mark(table: pa.Table) -> pa.Table:
        each = [np.cumsum(_unplanes(_unzip(x), "<u8")) for x in table["hashes"].to_pylist()]
        twice = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(h)) for x, h in zip(table["twice"].to_pylist(), each, strict=True)]
        _, back, counts = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
        hit = (counts + np.bincount(back, np.concatenate(twice))) > 1
        hot = hit & (np.bincount(back, np.concatenate([_unplanes(_unzip(x), "<u4") for x in table["times"].to_pylist()])) > HOT)
        ends = np.cumsum([len(h) for h in each])
        bounds = list(zip([0, *ends], ends))
        bits = [np.packbits(hit[back[a:b]]).tobytes() for a, b in bounds]
        hots = [np.packbits(x).tobytes() if (x := hot[back[a:b]]).any() else b"" for a, b in bounds]
        return pa.table({"run": table["run"], "part": table["part"], "bits": pa.array(bits, pa.binary()), "hots": pa.array(hots, pa.binary())})

    marks = runs.mapInArrow(frugal(send_hashes), "part int, run long, hashes binary, twice binary, times binary").groupBy("part").applyInArrow(frugal_group(mark), "run long, part int, bits binary, hots binary")
    marks = materialize(marks, "marks")

    def told_marks(told: pa.Table) -> dict[int, tuple[bytes, bytes]]:
        return dict(zip(told["part"].to_pylist(), zip(told["bits"].to_pylist(), told["hots"].to_pylist(), strict=True), strict=True))

    def send_suffixes(docs: pa.Table, told: pa.Table) -> pa.Table:
        s = _marked(Run(docs), told_marks(told), parts)
        number = told["run"][0].as_py() if told.num_rows else 0
        bounds = np.searchsorted(s["part"], np.arange(2 * parts + 1))
        rows = [(p, front_code(s, np.arange(a, b))) for p, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) if b > a]
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "run": pa.array([number] * len(rows), pa.int64()), "suffixes": pa.array([r[1] for r in rows], pa.binary())})

    def sort(table: pa.Table) -> pa.Table:
        flags = [_zip(_planes(f.astype("<u4"))) for f in merge_part(table["suffixes"].to_pylist(), table["part"][0].as_py() >= parts)]
        return pa.table({"run": table["run"], "part": table["part"], "flags": pa.array(flags, pa.binary())})

    sent = _over_runs(runs, marks, send_suffixes, "part int, run long, suffixes binary")
    flags = materialize(sent.groupBy("part").applyInArrow(frugal_group(sort), "run long, part int, flags binary"), "flags")
    told = marks.withColumn("flags", F.lit(None).cast("binary")).unionByName(flags.selectExpr("run", "part", "null as bits", "null as hots", "flags"))

    target = StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string") if digest else docs.schema
    arrow = to_arrow_schema(target)

    def cut(docs: pa.Table, told: pa.Table) -> pa.Table:
        run = Run(docs)
        is_mark = pc.is_valid(told["bits"])
        flagged = told.filter(pc.invert(is_mark))
        gone = _cut(run, told_marks(told.filter(is_mark)), dict(zip(flagged["part"].to_pylist(), flagged["flags"].to_pylist(), strict=True)), parts)
        total = _before(gone)
        begins = gone & ~np.concatenate(([False], gone[:-1]))
        inside = run.starts[run.starts < run.ends]
        begins[inside] = gone[inside]
        spans = _before(begins)
        kept = run.bytes[~gone].tobytes()
        texts = [kept[a:b] for a, b in zip((run.starts - total[run.starts]).tolist(), (run.ends - total[run.ends]).tolist(), strict=True)]
        if digest:
            columns = [docs["doc_id"], run.ends - run.starts, (total[run.ends] - total[run.starts]).astype(np.int64), (spans[run.ends] - spans[run.starts]).astype(np.int64), [hashlib.sha256(t).hexdigest() for t in texts]]
            return pa.table([c if isinstance(c, pa.ChunkedArray) else pa.array(c) for c in columns], names=arrow.names).cast(arrow)
        lost = total[run.ends] > total[run.starts]
        new = [t.decode("utf-8", "ignore") if x else old for t, x, old in zip(texts, lost.tolist(), docs["text"].to_pylist(), strict=True)]
        out = docs.set_column(docs.schema.get_field_index("text"), "text", pa.array(new, pa.string()))
        if "n_chars" in docs.schema.names:
            counts = [len(t) if x else old for t, x, old in zip(new, lost.tolist(), docs["n_chars"].to_pylist(), strict=True)]
            at = docs.schema.get_field_index("n_chars")
            out = out.set_column(at, "n_chars", pa.array(counts, docs.schema.field(at).type))
        return out.cast(arrow)

    return _over_runs(runs, told, cut, target)
