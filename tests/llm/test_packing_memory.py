"""What packing holds while it encodes doesn't grow with a batch."""

import tracemalloc

import numpy as np
import pyarrow as pa

from granary.llm import packing, queries


def test_encoding_holds_a_small_part_of_a_batch():
    words = np.array([f"word{i}" for i in range(2000)])
    rng = np.random.default_rng(4)
    texts = [" ".join(words[rng.integers(0, 2000, 400)]) + f" {i}" for i in range(2000)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    encoder = packing.Encoder(open(queries.tokenizer_path("word_bpe_49k.json"), encoding="utf-8").read())
    got = 0
    tracemalloc.start()
    for part in packing._slices(batch):
        ids, bounds = encoder.encode(part.column("text"), [packing.END])
        got += len(bounds) - 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == len(texts) and batch.nbytes > 6_000_000
    assert peak < 30_000_000, f"{peak / 1e6} MB"
