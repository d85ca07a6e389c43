"""Best-fit packing of token sequences by exact-complement hashing.

Documents become pieces of at most CAPACITY tokens; only their lengths matter for packing, so the plan is made on the
histogram of lengths (at most CAPACITY entries, whatever the input). The planner takes the longest available length and
looks whether the gap is exactly filled by one length, or a sum of two, or of three that are available; the sums lie in
tables indexed by the gap. It uses such a combination as often as the availability counts allow. Where no combination
fits, it puts in the longest available length that fits (best fit) and looks again. A plan has a few recipes for each
length; the pieces then find their place by their rank among those of their length.

Ranks: pieces of a length are dealt by a hash to as many parts as their count needs, counted, and numbered inside their
part, so that a length that very many documents share doesn't land in one task. The driver gets at most CAPACITY + PARTS
counts.

Token ids: `tokenizers` with the file of the given path and add_special_tokens=False, then END. The string of an added token
in a text is that token, as the library has it. Texts are cut at ASCII white space, the distinct chunks of a batch into the
tokenizer's own words, and each distinct word goes to the library's model once per worker (a table of bounded size). Texts
with a character beyond U+017F or such a string go to the library whole.

Defined results: null and empty texts are the single id END; texts of any length are encoded whole. Repeated rows are packed
each for itself; pieces of equal length, id and number take any order among themselves. A null doc_id stays null. Empty
tables give no rows. Columns other than doc_id and text are left out, whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import frugal, kept, map_batches, materialize

CAPACITY, END = 2048, 0
#: Pieces of a length that are numbered in one part, or so many as make PARTS of all pieces.
RANKED, PARTS = 20_000, 20_000
#: Words that a Python worker remembers, and bytes of texts that it works on at once.
MAX_WORDS, BYTES_AT_ONCE = 400_000, 1_000_000
#: Characters up to here go the fast way, but for those that the tokenizer's lower case and Python's treat unlike.
FAST_LIMIT = 0x180


def _class(kind: str) -> str:
    """A character class of all characters up to FAST_LIMIT whose Unicode category begins so."""
    return "".join(f"\\u{c:04x}" for c in range(FAST_LIMIT) if unicodedata.category(chr(c)).startswith(kind))


_SPACE = "\\t-\\r\\u0020\\u0085\\u00a0"
_WORDS = re.compile(f"[{_class('L')}]+|[{_class('N')}]|'(?:s|t|re|ve|m|ll|d)|[^{_SPACE}{_class('L')}{_class('N')}]+")
_WORDS_AND_ENDS = re.compile(f"{_WORDS.pattern}|\n")
_SLOW = re.compile("[^\u0000-\u012f\u0131-\u017f]")


def _byte_characters() -> dict[int, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace()]
    rest = [b for b in range(256) if b not in plain]
    return {b: 256 + n for n, b in enumerate(rest)}


class Encoder:
    """Ids of texts, exactly as the library gives them, with a table of words seen."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(tokenizer_json)
        self.model = self.library.model
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        #: Texts of which lower-cased parts look like added tokens go to the library whole, whether or not it finds one.
        self.added = re.compile("|".join(re.escape(t.lower()) for t in added) or "(?!)")
        self.bytes = _byte_characters()
        self.clear()

    def clear(self) -> None:
        #: Words by number; the numbers' ids lie end to end in flat, from starts on. Number 0 is a gap, without ids.
        self.known: dict[str, int] = {"\n": 0}
        self.flat, self.sizes = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def learn(self, words: list[str]) -> None:
        ids, sizes = [], []
        for word in words:
            symbols = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.bytes)
            got = [t.id for t in self.model.tokenize(symbols)]
            ids += got
            sizes.append(len(got))
        self.known.update(zip(words, range(len(self.sizes), len(self.sizes) + len(words)), strict=True))
        self.flat, self.sizes = np.concatenate((self.flat, np.array(ids, "<u4"))), np.concatenate((self.sizes, np.array(sizes, np.int64)))

    def encode(self, texts: pa.Array, end: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each followed by `end`, and the texts' bounds."""
        lists = pc.ascii_split_whitespace(texts.cast(pa.string()))
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        chunks = lists.flatten().dictionary_encode()
        chunk, n_distinct = chunks.indices.to_numpy(), len(chunks.dictionary)
        joined = pc.binary_join(pa.ListArray.from_arrays([0, n_distinct], chunks.dictionary), "\n")[0].as_py()
        low = joined.lower()
        slow = {}
        if _SLOW.search(joined) or self.added.search(low):
            slow = {i: t for i, t in enumerate(texts.to_pylist()) if _SLOW.search(t) or self.added.search(t.lower())}
            low = _SLOW.sub(" ", joined).lower()  # keeps one line a chunk; texts with these go to the library
        words = _WORDS_AND_ENDS.findall(low)
        if len(self.known) > MAX_WORDS:
            self.clear()
        number = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        if len(fresh := np.flatnonzero(number < 0)):
            new = [words[i] for i in fresh.tolist()]
            self.learn(list(set(new)))
            number[fresh] = np.fromiter(map(self.known.__getitem__, new), np.int64, len(new))
        # ids of the distinct chunks, then of the end, then of the texts that went to the library
        last = np.append(np.flatnonzero(number == 0), len(number))[:n_distinct]
        flat, word_bounds = _gather(self.flat, self.sizes, number)
        tail = [np.array(end or [], "<u4")] + [np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4") for t in slow.values()]
        sizes = np.append(np.diff(word_bounds[last], prepend=0), list(map(len, tail)))
        flat = np.concatenate((flat, *tail))
        each = [chunk[a:b] for a, b in zip(bounds, bounds[1:], strict=False)] if slow else []
        for n, i in enumerate(slow):
            each[i] = np.array([n_distinct + 1 + n])
        if slow:
            chunk, bounds = np.concatenate(each), np.cumsum([0, *map(len, each)])
        chunk = np.insert(chunk.astype(np.int64), bounds[1:], n_distinct)
        ids, ends = _gather(flat, sizes, chunk)
        return ids, ends[bounds + np.arange(len(bounds))]


def _gather(flat: np.ndarray, sizes: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of flat (of these sizes, end to end) with the given numbers end to end, and their bounds."""
    starts, own = np.cumsum(sizes) - sizes, sizes[number]
    bounds = np.concatenate(([0], np.cumsum(own)))
    return flat[np.repeat(starts[number] - bounds[:-1], own) + np.arange(bounds[-1])], bounds


def encoder_of(tokenizer_json: str) -> Encoder:
    """One encoder a Python worker, so that later tasks of the stage find the words of earlier ones."""
    return kept("encoder", hash(tokenizer_json), lambda: Encoder(tokenizer_json))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of about BYTES_AT_ONCE of text, or of one row."""
    before = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        done = before[begin - 1] if begin else 0
        end = max(int(np.searchsorted(before, done + BYTES_AT_ONCE, "right")), begin + 1)
        yield batch.slice(begin, end - begin)
        begin = end


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, as asked for) of every piece of every row of docs."""
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer_json = file.read()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_json)
        for part in (p for batch in batches for p in _slices(batch)):
            ids, bounds = encoder.encode(pc.fill_null(part.column("text"), ""), [END])
            sizes = np.diff(bounds)
            counts = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), counts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            start = piece * capacity
            length = np.minimum(sizes[row] - start, capacity)
            at = bounds[row] + start
            data = memoryview(ids.tobytes())
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
            columns = [part.column("doc_id").take(pa.array(row)), piece, start, length, crc]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(ids.astype(np.int64))))
            arrays = [(c if isinstance(c, pa.Array) else pa.array(c)).cast(f.type) for c, f in zip(columns, target, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(frugal(run, "encoder"), schema)


class _Available:
    """Counts of lengths, and which sums of two available lengths there are."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.count = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.count[length] = n
        here = self.here
        self.pair_sums = np.array([sum(here[a] and here[s - a] for a in range(1, s // 2 + 1)) for s in range(capacity + 1)]) if capacity <= 64 else self._sums(here)

    @property
    def here(self) -> np.ndarray:
        return self.count > 0

    @staticmethod
    def _sums(here: np.ndarray) -> np.ndarray:
        """For each sum, how many unordered pairs of available lengths have it."""
        n = len(here)
        both = np.rint(np.fft.irfft(np.fft.rfft(here.astype(float), 2 * n) ** 2, 2 * n))[:n].astype(np.int64)
        twice = np.zeros(n, np.int64)
        twice[::2] = here[: (n + 1) // 2]
        return (both + twice) // 2

    def take(self, lengths: list[int], times: int) -> None:
        for length in lengths:
            self.count[length] -= times
        for length in set(lengths):
            if self.count[length] == 0:  # its pairs go
                others = np.flatnonzero(self.here)
                others = others[others + length < len(self.count)]
                self.pair_sums[others + length] -= 1
                if 2 * length < len(self.count):
                    self.pair_sums[2 * length] -= 1

    def times(self, lengths: list[int]) -> int:
        return min(int(self.count[x]) // lengths.count(x) for x in set(lengths))

    def pair(self, gap: int, held: list[int]) -> list[int] | None:
        """The two lengths with this sum, the longer one as long as can be."""
        if gap < 2 or self.pair_sums[gap] <= 0:
            return None
        here = self.here
        for a in np.flatnonzero(here[(gap + 1) // 2 : gap] & here[gap // 2 : 0 : -1][: gap - (gap + 1) // 2])[::-1].tolist():
            found = [a + (gap + 1) // 2, gap - a - (gap + 1) // 2]
            if self.times(held + found):
                return found
        return None

    def fill(self, gap: int, held: list[int]) -> list[int] | None:
        """One, two or three available lengths that fill the gap exactly."""
        if self.count[gap] > 0 and self.times([*held, gap]):
            return [gap]
        if found := self.pair(gap, held):
            return found
        here = np.flatnonzero(self.here[:gap])
        for a in here[self.pair_sums[gap - here] > 0][::-1].tolist():
            if self.times([*held, a]) and (found := self.pair(gap - a, [*held, a])):
                return [a, *found]
        return None

    def longest(self, most: int, held: list[int]) -> int | None:
        for a in np.flatnonzero(self.here[: most + 1])[::-1].tolist():
            if self.times([*held, a]):
                return a
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Recipes: the lengths of a sequence, and how many sequences are so filled."""
    available, out = _Available(counts, capacity), []
    for first in range(capacity, 0, -1):
        while available.count[first] > 0:
            held, gap = [first], capacity - first
            while gap:
                if found := available.fill(gap, held):
                    held += found
                    break
                nearest = available.longest(gap, held)
                if nearest is None:
                    break
                held.append(nearest)
                gap -= nearest
            times = available.times(held)
            available.take(held, times)
            out.append((held, times))
    return out


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows that have doc_id, piece and length."""
    lengths = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}  # at most capacity rows
    most = max(RANKED, sum(lengths.values()) // PARTS)
    table = parts.sparkSession.createDataFrame([(k, -(-n // most)) for k, n in sorted(lengths.items())], "length long, salts int")
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts")).cast("int")
    parts = parts.join(F.broadcast(table), "length").select(*parts.columns, salt.alias("salt"))
    counts = parts.groupBy("length", "salt").count().collect()  # at most capacity + PARTS rows
    sizes: dict[int, int] = {}
    offsets = []
    for r in sorted(counts, key=lambda r: (r["length"], r["salt"])):
        offsets.append((r["length"], r["salt"], sizes.get(r["length"], 0)))
        sizes[r["length"]] = sizes.get(r["length"], 0) + r["count"]
    slots: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for lengths, times in plan(sizes, capacity):
        at = 0
        for length in lengths:
            slots.setdefault(length, []).append((used.get(length, 0), base, at))
            used[length] = used.get(length, 0) + times
            at += length
        base += times
    table = {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in slots.items()}
    first = {(length, salt): n for length, salt, n in offsets}
    columns = [c for c in parts.columns if c != "salt"]
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece"))
    ranked = parts.withColumn("rank", rank.cast("long"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name in columns) + ", sequence_id long, offset long"

    def make():
        def step(batch: dict) -> dict:
            salts, ranks = batch.pop("salt"), batch.pop("rank")
            sequence, offset = [], []
            for length, salt, r in zip(batch["length"], salts, ranks, strict=True):
                at = first[length, salt] + r - 1
                start, seq, place = table[length]
                i = int(np.searchsorted(start, at, "right")) - 1
                sequence.append(int(seq[i] + at - start[i]))
                offset.append(int(place[i]))
            return batch | {"sequence_id": sequence, "offset": offset}

        return step

    return map_batches(ranked, make, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all rows of docs with their sequence and their place in it."""
    return pack(materialize(pieces(docs, tokenizer_path, capacity), "pieces"), capacity)
