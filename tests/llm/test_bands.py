"""Bands of fingerprints, of every kind, lose no link."""

import numpy as np
import pytest

from granary.llm import simhash
from granary.llm.common import materialize
from granary.llm.graph import components, forest


@pytest.mark.parametrize(("nodes", "blocks"), [(0, 1), (1_000_000, 2), (10**9, 3), (10**12, 4)])
def test_bands_of_more_nodes_are_larger(nodes, blocks):
    bands = simhash.sharing_bands(4, nodes)
    assert len(bands) == {1: 5, 2: 15, 3: 35, 4: 70}[blocks]
    assert min(map(len, bands)) >= 64 * blocks // (4 + blocks) - blocks
    rng = np.random.default_rng(nodes % 7)
    for _ in range(500):
        differ = set(rng.choice(64, 4, replace=False).tolist())
        assert any(not differ.intersection(b) for b in bands)


@pytest.mark.parametrize("nodes", [0, 1_000_000, 10**12])
def test_links_equal_all_pairs(spark, nodes):
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    for _ in range(240):  # chains of neighbours at up to five bits
        flips = rng.choice(64, rng.integers(1, 6), replace=False).astype(np.uint64)
        fps = np.append(fps, fps[rng.integers(len(fps))] ^ np.bitwise_or.reduce(np.uint64(1) << flips))
    fps = np.unique(fps)
    low = np.arange(len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 4
    while True:  # smallest row that links reach
        new = np.where(near, low[None], len(fps)).min(axis=1)
        if (new == low).all():
            break
        low = new
    signed = fps.view(np.int64)
    df = spark.createDataFrame([(int(f), int(f)) for f in signed], "node long, w0 long")
    root = {r["node"]: r["root"] for r in components(simhash.links(df, simhash.sharing_bands(4, nodes), 4)).collect()}
    groups = {}
    for i, f in enumerate(signed.tolist()):
        groups.setdefault(root.get(f, f), set()).add(int(low[i]))
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(low.tolist()))


def test_all_links_lose_none_at_the_radius(spark, monkeypatch):
    """Pairs at the very radius are found, one more bit is too far; also across blocks, and in groups whose links are cut down."""
    monkeypatch.setattr(simhash, "BLOCK", 100)
    monkeypatch.setattr(simhash, "HELD_LINKS", 50)
    rng = np.random.default_rng(5)
    radius = simhash.wide_radius()

    def flipped(words, n):
        flips = rng.choice(256, n, replace=False)
        out = words.copy()
        for f in flips.tolist():
            out[f // 64] ^= np.uint64(1) << np.uint64(f % 64)
        return out

    base = rng.integers(0, 1 << 63, (300, 4), dtype=np.uint64)
    at, beyond = [np.array([flipped(w, radius + more) for w in base]) for more in (0, 1)]
    crowd = np.array([flipped(base[0], 3) for _ in range(60)])
    fps = np.concatenate((base, at, beyond, crowd)).view(np.int64)
    df = spark.createDataFrame([(n, *map(int, w)) for n, w in enumerate(fps)], "node long, w0 long, w1 long, w2 long, w3 long")
    root = {r["node"]: r["root"] for r in components(simhash.all_links(df, len(fps), radius)).collect()}
    assert [root.get(n) for n in range(300, 600)] == list(range(300))
    near = np.bitwise_count((fps[:, None] ^ fps[None]).view(np.uint64)).sum(axis=2) <= radius
    low = np.arange(len(fps))
    while True:
        new = np.where(near, low[None], len(fps)).min(axis=1)
        if (new == low).all():
            break
        low = new
    assert [root.get(n, n) for n in range(len(fps))] == low.tolist()


@pytest.mark.parametrize("held", [10, 1_000_000])
def test_block_links_of_tiles(monkeypatch, held):
    monkeypatch.setattr(simhash, "HELD_LINKS", held)
    monkeypatch.setattr(simhash, "TILE_ROWS", 8)
    monkeypatch.setattr(simhash, "TILE_COLUMNS", 16)
    rng = np.random.default_rng(6)
    left, right = (rng.integers(0, 8, (2, n), dtype=np.uint64) for n in (45, 70))
    for other in (None, right):
        every = left if other is None else np.concatenate((left, right), axis=1)
        a, b = simhash.block_links(left, other, 1)
        near = np.bitwise_count(every[:, :, None] ^ every[:, None]).sum(axis=0) <= 1
        if other is not None:
            near[:45, :45] = near[45:, 45:] = False
        x, y = np.nonzero(near)
        assert (forest(every.shape[1], a, b) == forest(every.shape[1], x, y)).all()


def test_all_links_send_no_node_for_each_block(spark, monkeypatch):
    """A pair of blocks reads both from the work table: nodes are packed once each, and no shuffle lies behind the blocks."""
    monkeypatch.setattr(simhash, "BLOCK", 100)
    written = []
    monkeypatch.setattr(simhash, "materialize", lambda df, name: written.append(materialize(df, name)) or written[-1])
    df = spark.range(1500).selectExpr("id as node", "xxhash64(id) as w0", "xxhash64(id, 1) as w1")
    links = simhash.all_links(df, 1500, 3)
    assert "Exchange" not in links._jdf.queryExecution().executedPlan().toString()
    assert written[0].count() == 15 and written[0].selectExpr("sum(length(packed))").first()[0] == 1500 * 3 * 8
    assert links.count() == 0
