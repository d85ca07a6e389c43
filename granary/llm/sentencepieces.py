"""SentencePiece encoding and decoding by vectorised merge rounds.

A word is cut into symbols that lie, for all new words of a batch, in one flat numpy array. Each round looks up the
rank of every adjacent pair, takes the minimum of each segment (np.minimum.reduceat), merges all leftmost pairs of that
rank at once, and compacts the arrays; it ends when no pair is left.

Merging all pairs of one rank at once gives what the one-by-one merge gives, unless a merged piece can at once take
part in a merge of the same or a better rank. Such pieces are known from the vocabulary; of them only the leftmost is
merged in a round.

Segments: two characters that stand side by side in no piece can never be in one token, so texts are cut there.

Defined results: null and empty texts have no tokens, and decode to the empty text. Repeated rows each give their row.
Words already seen in a task are kept in a table of bounded size; that only saves time.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame

from .common import map_batches

SPACE = "▁"
_WORDS = re.compile(f"{SPACE}+[^{SPACE}]*")
_NEVER = np.iinfo(np.int64).max
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Words kept by a task, and their characters, at most.
CACHED_WORDS, CACHED_CHARS = 200_000, 4_000_000


def read_model(path: str) -> dict:
    """The parts of a SentencePiece BPE model file that encoding and decoding need."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    norm = proto.normalizer_spec
    if proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces or not proto.trainer_spec.byte_fallback:
        raise ValueError("only BPE models with byte fallback, a dummy prefix and no normalisation are supported")
    kinds = [x.type for x in proto.pieces]
    if 4 in kinds or 5 in kinds:
        raise ValueError("user-defined and unused pieces are not supported")
    return {"pieces": [x.piece for x in proto.pieces], "scores": [x.score for x in proto.pieces], "kinds": kinds}


class PairTable:
    """Open addressing over numpy arrays: finds the places of many keys at once."""

    def __init__(self, keys: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(len(keys) * 4).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.last = size - 1
        self.keys, self.places = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == -1]
            self.keys[slot[free]], self.places[slot[free]] = keys[free], free
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & self.last

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _MIX) >> self.shift).view(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each key, and whether it is there at all."""
        slot = self._slot(keys)
        got = self.keys[slot]
        left = np.flatnonzero((got != keys) & (got != -1))
        while len(left):
            slot[left] = (slot[left] + 1) & self.last
            got[left] = self.keys[slot[left]]
            left = left[(got[left] != keys[left]) & (got[left] != -1)]
        return self.places[slot], got == keys


class PieceCodec:
    """Encodes words to ids and ids to text, by the model that read_model() gives."""

    def __init__(self, model: dict):
        pieces, kinds = model["pieces"], model["kinds"]
        self.size = len(pieces)
        normal = {p: i for i, p in enumerate(pieces) if kinds[i] == 1}
        self.byte_ids = np.zeros(256, np.int64)
        raw = []
        for i, p in enumerate(pieces):
            if kinds[i] == 6:
                self.byte_ids[int(p[3:5], 16)] = i
                raw.append(bytes([int(p[3:5], 16)]))
            else:
                raw.append(p.replace(SPACE, " ").encode() if kinds[i] == 1 else b"")
        symbols = dict(normal)
        for p in normal:
            for c in p:
                if c not in symbols:
                    symbols[c] = self.size + len(symbols) - len(normal)
        self.chars = {ord(s): i for s, i in symbols.items() if len(s) == 1}
        self.first_unknown = self.size + len(symbols) - len(normal)
        self.extra = {i: ord(s) for s, i in symbols.items() if i >= self.size}
        _, order = np.unique(-np.array(model["scores"]), return_inverse=True)
        pairs, bigrams = {}, set()
        for p, i in normal.items():
            for k in range(1, len(p)):
                bigrams.add((symbols[p[k - 1]] << 32) | symbols[p[k]])
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a is not None and b is not None:
                    pairs[(a << 32) | b] = i
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.ranks = order[self.merged].astype(np.int64)
        self.pairs, self.bigrams = PairTable(self.keys), PairTable(np.array(sorted(bigrams), np.int64))
        rank_of = np.full(self.first_unknown, _NEVER)
        rank_of[: self.size] = order
        alone = np.zeros(self.first_unknown, bool)
        for part in (self.keys >> 32, self.keys & 0xFFFFFFFF):
            alone[part[self.ranks <= rank_of[part]]] = True
        self.alone = alone
        lengths = np.array([len(x) for x in raw], np.int64)
        self.raw, self.raw_start, self.raw_len = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(lengths) - lengths, lengths

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and how many each word has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(points):
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        kinds, inverse = np.unique(points, return_inverse=True)
        unknown = {c: self.first_unknown + n for n, c in enumerate(c for c in kinds.tolist() if c not in self.chars)}
        sym = np.array([self.chars.get(c, unknown.get(c)) for c in kinds.tolist()], np.int64)[inverse]
        word = np.repeat(np.arange(len(words)), sizes)
        joined = self.bigrams.find((sym[:-1] << 32) | sym[1:])[1] & (word[1:] == word[:-1])
        segment = np.concatenate(([0], np.cumsum(~joined)))
        alive, at = np.ones(len(sym), bool), np.arange(len(sym))
        while len(at) > 1:
            seg, s = segment[at], sym[at]
            same = seg[1:] == seg[:-1]
            where, hit = self.pairs.find((s[:-1] << 32) | s[1:])
            hit &= same
            rank = np.append(np.where(hit, self.ranks[where], _NEVER), _NEVER)
            start = np.flatnonzero(np.concatenate(([True], ~same)))
            best = np.minimum.reduceat(rank, start)
            run = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(at))))
            chosen = (rank == best[run]) & (rank != _NEVER)
            first = np.flatnonzero(chosen)
            if not len(first):
                break
            # leftmost pairs that don't overlap: every other one of a row of chosen neighbours
            fresh = np.concatenate(([True], (np.diff(first) > 1) | (run[first[1:]] != run[first[:-1]])))
            begin = first[np.maximum.accumulate(np.where(fresh, np.arange(len(first)), 0))]
            take = (first - begin) % 2 == 0
            piece = self.merged[where[first]]
            lead = np.concatenate(([True], run[first[1:]] != run[first[:-1]]))
            take &= lead | ~self.alone[piece][np.maximum.accumulate(np.where(lead, np.arange(len(first)), 0))]
            first, piece = first[take], piece[take]
            sym[at[first]] = piece
            alive[at[first + 1]] = False
            keep = (best != _NEVER)[run]
            keep[first + 1] = False
            at = at[keep]
        sym, word = sym[alive], word[alive]
        odd = np.flatnonzero(sym >= self.size)
        if len(odd):
            back = self.extra | {i: c for c, i in unknown.items()}
            raw = [chr(back[i]).encode("utf-8", "surrogatepass") for i in sym[odd].tolist()]
            counts = np.ones(len(sym), np.int64)
            counts[odd] = [len(x) for x in raw]
            is_odd = np.repeat(sym >= self.size, counts)
            sym, word = np.repeat(sym, counts), np.repeat(word, counts)
            sym[is_odd] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return sym, np.bincount(word, minlength=len(words))

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of the ids as UTF-8: without the dummy prefix; bytes that are no UTF-8 become replacement characters."""
        if not len(ids):
            return b""
        n = self.raw_len[ids]
        out = self.raw[np.repeat(self.raw_start[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes()
        return out[1:] if self.raw_len[ids[0]] and out[:1] == b" " and ids[0] != self.byte_ids[32] else out

    def split(self, text: str) -> list[str]:
        return _WORDS.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str | None) -> np.ndarray:
        words = self.split(text or "")
        return self.encode_words(words)[0]


class _Seen:
    """Words of a task, with their ids as a ragged array and as decimal strings."""

    def __init__(self, codec: PieceCodec):
        self.codec = codec
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.said: list[str] = []
        self.ids, self.sizes, self.held = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def add(self, rows: list[list[str]]) -> None:
        if len(self.index) > CACHED_WORDS or self.held > CACHED_CHARS:
            self.clear()
        fresh = list(set().union(*rows).difference(self.index))
        if not fresh:
            return
        ids, sizes = self.codec.encode_words(fresh)
        self.index.update(zip(fresh, range(len(self.said), len(self.said) + len(fresh)), strict=True))
        decimals, end = list(map(str, ids.tolist())), np.cumsum(sizes).tolist()
        self.said += [",".join(decimals[a:b]) for a, b in zip([0, *end], end)]
        self.ids, self.sizes = np.concatenate((self.ids, ids)), np.concatenate((self.sizes, sizes))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.held += sum(map(len, fresh))

    def ids_of(self, at: np.ndarray) -> np.ndarray:
        n = self.sizes[at]
        return self.ids[np.repeat(self.starts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def encode(docs: DataFrame, model_path: str, with_ids: bool = True, with_digests: bool = False) -> DataFrame:
    """doc_id, n_tokens and, as asked for, ids and decoded text, or the digests of both, of every row of docs."""
    model = read_model(model_path)
    schema = "doc_id long, n_tokens long" + ", ids array<int>, decoded string" * with_ids + ", ids_sha256 string, decoded_sha256 string" * with_digests

    def make():
        seen = _Seen(PieceCodec(model))

        def step(batch: dict) -> dict:
            out: dict[str, list] = {x.split()[0]: [] for x in schema.split(", ")}
            out["doc_id"] = batch["doc_id"]
            texts = batch["text"]
            for begin in range(0, len(texts), 200):
                rows = [seen.codec.split(t or "") for t in texts[begin : begin + 200]]
                seen.add(rows)
                for words in rows:
                    at = list(map(seen.index.__getitem__, words))
                    ids = seen.ids_of(np.array(at, np.int64)) if at else np.zeros(0, np.int64)
                    decoded = seen.codec.decode(ids)
                    out["n_tokens"].append(len(ids))
                    if with_ids:
                        out["ids"].append(ids.tolist())
                        out["decoded"].append(decoded.decode("utf-8", "replace"))
                    if with_digests:
                        out["ids_sha256"].append(hashlib.sha256(",".join(map(seen.said.__getitem__, at)).encode()).hexdigest())
                        out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
            return out

        return step

    return map_batches(docs.select("doc_id", "text"), make, schema)
