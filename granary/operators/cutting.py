"""Chunks of many documents at once as bags of tokens, for an index that needs no chunk's text.

The chunks and their tokens are those of chunking.fixed, semantic (with text.tokens and text.jaccard) and agentic_eval (with
providers.overlap_planner). Chunks overlap, and a chunk of sentences has the tokens of its sentences, so a document is cut into
tokens once, and its chunks are ranges of them; the work grows with the text, whatever the sentences of a document.
"""

from __future__ import annotations

import unicodedata
from functools import cache, cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa

WORD, SPACE, STOP = 1, 2, 4
#: Lower-cased it becomes an i and a mark, which ends a word.
DOTTED = 0x130


@cache
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: whether it is a letter, digit or underscore, white space or a sentence's end, and its a-z or 0-9 (else 0)."""
    kind, low = np.zeros(0x110000, np.uint8), np.zeros(0x110000, np.uint8)
    kind[[i for i in range(0x110000) if unicodedata.category(chr(i))[0] in "LN"]] = WORD
    kind[ord("_")] = WORD
    kind[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    kind[[ord(c) for c in ".!?"]] = STOP
    for c in "abcdefghijklmnopqrstuvwxyz0123456789":
        low[[ord(c), ord(c.upper())]] = ord(c)
    low[DOTTED], low[0x212A] = ord("i"), ord("k")  # the second is the sign of kelvin
    return kind, low


def ranges(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    total = int(sizes.sum())
    kind = np.int32 if max(total, int(begin.max(initial=0))) < 2**31 else np.int64
    out = np.repeat((begin - (np.cumsum(sizes) - sizes)).astype(kind), sizes)
    out += np.arange(total, dtype=kind)
    return out


class Bags(NamedTuple):
    """Chunks: the number of the document, the place there, and a range of ids, which are numbers of terms."""

    doc: np.ndarray
    place: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    ids: np.ndarray
    terms: pa.Array


class Texts:
    """Texts as code points, each with a line feed behind it."""

    def __init__(self, texts: list[str]):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.end = np.cumsum(sizes + 1) - 1
        self.begin = self.end - sizes
        code = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
        kind, low = _classes()
        kind, self.low = kind[code], low[code]
        word, inner = kind == WORD, kind != SPACE
        joins = word & (code != DOTTED)  # a word goes on behind it
        #: Runs of letters and digits, and of all but white space.
        self.words = self._runs(word, word[1:] & joins[:-1])
        self.pieces = self._runs(inner, inner[1:] & inner[:-1])
        self.stops = kind[self.pieces[1] - 1] == STOP
        self.odd = np.append(0, np.cumsum(word & (self.low == 0), dtype=np.int32))

    @staticmethod
    def _runs(inside: np.ndarray, goes_on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(1, bool)
        return np.flatnonzero(inside & ~np.concatenate((none, goes_on))[: len(inside)]), np.flatnonzero(inside & ~np.concatenate((goes_on, none))[: len(inside)]) + 1

    def plain(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether words are tokens: all of a-z and 0-9 in lower case."""
        return self.odd[end] == self.odd[begin]

    def encoded(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """Ids of words, and the terms that they are numbers of."""
        data = self.low[ranges(begin, end - begin)]
        offsets = np.append(0, np.cumsum(end - begin)).astype(np.int32)
        out = pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        return out.indices.to_numpy(zero_copy_only=False).astype(np.int64), out.dictionary

    @cached_property
    def sentences(self) -> tuple[np.ndarray, np.ndarray]:
        """Where sentences begin, and their documents."""
        doc = np.searchsorted(self.begin, self.pieces[0], "right") - 1
        opens = np.ones(len(doc), bool)
        opens[1:] = (doc[1:] != doc[:-1]) | self.stops[:-1]
        return self.pieces[0][opens], doc[opens]


def fixed(texts: Texts, size: int = 1000, overlap: int = 200) -> Bags:
    step = size - overlap
    counts = np.maximum(texts.end - texts.begin - overlap - 1, 0) // step + 1
    doc = np.repeat(np.arange(len(counts)), counts)
    start = ranges(np.zeros(len(counts), np.int64), counts) * step + texts.begin[doc]
    stop = np.minimum(start + size, texts.end[doc])
    filled = np.searchsorted(texts.pieces[0], stop) > np.searchsorted(texts.pieces[1], start, "right")
    doc, start, stop = doc[filled], start[filled], stop[filled]
    place = np.arange(len(doc)) - np.searchsorted(doc, doc)
    first = np.searchsorted(texts.words[1], start, "right")
    sizes = np.maximum(np.searchsorted(texts.words[0], stop) - first, 0)
    word, window = ranges(first, sizes), np.repeat(np.arange(len(doc)), sizes)
    begin, end = np.maximum(texts.words[0][word], start[window]), np.minimum(texts.words[1][word], stop[window])
    cut = (begin > texts.words[0][word]) | (end < texts.words[1][word])
    plain = texts.plain(begin, end)
    # words that a window's edge cuts are words of their own
    whole, part = texts.plain(*texts.words), cut & plain
    codes, terms = texts.encoded(*(np.concatenate((w[whole], e[part])) for w, e in zip(texts.words, (begin, end), strict=True)))
    of_word = np.full(len(whole), -1)
    of_word[whole] = codes[: whole.sum()]
    ids = of_word[word]
    ids[part] = codes[whole.sum() :]
    ends = np.cumsum(np.bincount(window[plain], minlength=len(doc)))
    return Bags(doc, place, np.append(0, ends)[:-1], ends, ids[plain], terms)


def _by_sentences(texts: Texts, breaks, most: int, least: int, overlap: int, whole: int) -> Bags:
    """Ranges of sentences as chunking.fold_ranges has them; documents of fewer than `whole` sentences stay whole.

    breaks: function of the documents of the sentences and, of each sentence, of the terms that it shares with the next and that
    one of both has.
    """
    tokens = texts.plain(*texts.words)
    begin, end = (w[tokens] for w in texts.words)
    ids, terms = texts.encoded(begin, end)
    starts, doc = texts.sentences
    n = max(len(starts), 1)
    pair = np.sort(ids * n + np.searchsorted(starts, begin, "right") - 1)
    pair = pair[np.diff(pair, prepend=-1) > 0]
    sentence = pair % n
    bag = np.bincount(sentence, minlength=len(starts))
    next_too = (np.diff(pair) == 1) & (sentence[1:] > 0)  # the same term in a sentence and in the next
    shared = np.bincount(sentence[:-1][next_too], minlength=len(starts))
    total = bag + np.append(bag[1:], np.zeros(min(len(bag), 1), np.int64)) - shared
    marked, counts = breaks(doc, shared, total).tolist(), np.bincount(doc, minlength=len(texts.begin))
    docs, places, heads, tails, at = [], [], [], [], 0
    for d, sentences in enumerate(counts.tolist()):
        held = place = 0
        for i in range(at, at + sentences if sentences >= whole else at):
            held += 1
            if held >= most or (marked[i] and held >= least):
                docs.append(d), places.append(place), heads.append(i - held + 1), tails.append(i)
                held, place = min(overlap, held), place + 1
        at += sentences
        if held:
            docs.append(d), places.append(place), heads.append(at - held), tails.append(at - 1)
    first = np.append(np.searchsorted(begin, starts), len(begin))
    alone = np.flatnonzero(counts < whole)
    bounds = np.searchsorted(begin, texts.begin[alone]), np.searchsorted(begin, texts.end[alone])
    docs, places, heads, tails = (np.array(x, np.int64) for x in (docs, places, heads, tails))
    return Bags(np.append(docs, alone), np.append(places, np.zeros_like(alone)), np.append(first[heads], bounds[0]), np.append(first[tails + 1], bounds[1]), ids, terms)


def semantic(texts: Texts, percentile: float = 0.7, most: int = 8, overlap: int = 2) -> Bags:
    def breaks(doc: np.ndarray, shared: np.ndarray, total: np.ndarray) -> np.ndarray:
        gap = np.flatnonzero(doc[1:] == doc[:-1])  # between a sentence and the next of its document
        of = doc[gap]
        # six digits, halves upwards
        likeness = (2_000_000 * shared[gap] + total[gap]) // (2 * np.maximum(total[gap], 1)) / 1e6
        ordered = likeness[np.lexsort((likeness, of))]
        start, count = np.searchsorted(of, of), np.searchsorted(of, of, "right") - np.searchsorted(of, of)
        rank = (count - 1) * percentile
        low = np.floor(rank).astype(np.int64)
        a, b = ordered[start + low], ordered[start + np.minimum(low + 1, count - 1)]
        out = np.zeros(len(doc), bool)
        out[gap] = likeness <= np.round(a * (1 - (rank - low)) + b * (rank - low), 9)
        return out

    return _by_sentences(texts, breaks, most, 2, overlap, 2)


def agentic(texts: Texts, share: float = 0.15, most: int = 6, least: int = 2, overlap: int = 1) -> Bags:
    """Windows of the planner overlap, so that each two neighbours are in one of them; a document's last sentence is no break."""

    def breaks(doc: np.ndarray, shared: np.ndarray, total: np.ndarray) -> np.ndarray:
        return (shared < share * np.maximum(total, 1)) & np.append(doc[1:] == doc[:-1], np.zeros(min(len(doc), 1), bool))

    return _by_sentences(texts, breaks, most, least, overlap, 3)
