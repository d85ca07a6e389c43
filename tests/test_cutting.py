"""Chunks cut in arrays against the column chunkers."""

import random
import time
from collections import Counter

import numpy as np
import pytest

from granary.functions import providers
from granary.functions import text as T
from granary.operators import chunking, cutting, index
from granary.plans import catalogue

COLUMNS = {"fixed": chunking.fixed, "semantic": lambda d: chunking.semantic(d, T.tokens, T.jaccard), "agentic": lambda d: chunking.agentic_eval(d, providers.overlap_planner)}
PARTS = ["a", "b", "Ab", "K", "İ", "é", "naïve", "ß", "Σ", "_", "x_y", "9", "²", "Ⅷ", ".", "!", "?", " ", "  ", "\n", " ", " ", "\x1c", "​", "😀", "語", "\r\n", "\t", "\x85", ". ", "? ", "ab cd. ", "é"]


def kept(made: index.Index) -> list:
    """Keys, terms with counts, and lengths of the rows of an index."""
    out = []
    for value in made.groups.select("packed").toArrow().column("packed"):
        group = index.Group(index.unpacked(value))
        bags = [Counter() for _ in group.keys]
        for term, row, count in zip(np.repeat(np.array(group.terms.to_pylist(), object), group.sizes), group.rows, group.counts, strict=True):
            bags[row][term] += int(count)
        keys = [tuple(k.values()) for k in group.keys.to_pylist()]
        assert keys == sorted(keys) and group.slots.tolist() == index._slots(group.terms).tolist()
        out += [(*k, sorted(b.items()), n) for k, b, n in zip(keys, bags, group.lengths.tolist(), strict=True)]
    return sorted(out)


@pytest.mark.parametrize("name", COLUMNS)
def test_chunks_are_those_of_the_columns(spark, monkeypatch, name):
    """Odd letters, marks and white space, words at a window's edge, null and empty texts, two documents of one id."""
    monkeypatch.setattr(index, "GROUP_ROWS", 50)
    monkeypatch.setattr(index, "CUT_BYTES", 20_000)
    rng = random.Random(7)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.choice([0, 1, 3, 10, 60, 400, 1500]))) for _ in range(150)]
    rows = [*enumerate(texts), (200, None), (201, ""), (202, " \n ."), (203, ". . ."), (1, "Twice a. Twice b c. d e.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = [(r[0], r[1], sorted(Counter(r[2]).items()), len(r[2])) for r in COLUMNS[name](docs).select("doc_id", "chunk_index", T.tokens("text")).collect()]
    assert kept(index.lexical_index(docs, ["doc_id", "chunk_index"], getattr(cutting, name))) == sorted(want)
    assert kept(index.lexical_index(docs.limit(0), ["doc_id", "chunk_index"], getattr(cutting, name))) == []


def test_work_grows_with_the_sentences(spark):
    """Breaks of a document are worked out once, not again for each of its sentences."""
    rng = random.Random(3)
    text = " ".join(" ".join(f"w{rng.randrange(30)}" for _ in range(8)) + "." for _ in range(6_000))
    docs, began = spark.createDataFrame([(1, text)], "doc_id long, text string"), time.time()
    made = catalogue._indexes(docs, ["semantic", "agentic"])
    rows = {n: COLUMNS[n](docs).count() for n in made}
    assert {n: made[n].rows for n in made} == rows and min(rows.values()) > 1_000
    assert time.time() - began < 60
