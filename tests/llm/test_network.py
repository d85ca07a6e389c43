"""The toxicity network's forward pass against plain loops, and what a training step does."""

import numpy as np

from granary.llm import toxicity


def plain_logit(net: toxicity.Network, words: list[str]) -> float:
    vectors = [net.embed[list(toxicity.buckets(w))].astype(float).sum(axis=0) for w in words]
    top = []
    for f in net.filters:
        for c in range(toxicity.FILTERS):
            values = [sum(float(vectors[i + k] @ f[k, :, c]) for k in range(len(f))) for i in range(len(words) - len(f) + 1)]
            top.append(max([0.0, *values]))
    return float(np.dot(top, net.out) + net.bias)


def test_forward_pass_equals_plain_loops():
    rng = np.random.default_rng(4)
    net = toxicity.Network(rng)
    net.embed += rng.normal(0, 0.3, net.embed.shape).astype(np.float32)
    for words in ([], ["one"], ["one", "two"], [f"w{i}" for i in rng.integers(0, 30, 40)]):
        kinds = sorted(set(words))
        tables = net.tables(np.array([toxicity.buckets(w) for w in kinds], np.int64).reshape(-1, 3))
        ids = np.array([kinds.index(w) for w in words], np.int64)
        assert abs(net.logit(ids, tables) - plain_logit(net, words)) < 1e-3


def test_training_tells_the_words_apart():
    rng = np.random.default_rng(6)
    kinds = [f"word{i}" for i in range(60)] + ["nasty", "vile"]
    rows, labels = [], []
    for i in range(300):
        ids = rng.integers(0, 60, rng.integers(5, 40))
        if i % 3 == 0:
            ids[rng.integers(len(ids))] = 60 + i % 2
        rows.append(ids)
        labels.append(int(i % 3 == 0))
    words = np.array([toxicity.buckets(w) for w in kinds], np.int64)
    net = toxicity.fit_network(rows, words, np.array(labels))
    tables = net.tables(words)
    fresh = [rng.integers(0, 60, 30) for _ in range(100)]
    marked = [np.append(x, 60 + i % 2) for i, x in enumerate(fresh)]
    assert min(net.logit(x, tables) for x in marked) > max(net.logit(x, tables) for x in fresh)
