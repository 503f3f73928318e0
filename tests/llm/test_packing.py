import random

import numpy as np

from spanforge.llm import packing

SCHEMA = "id long, text string, n long, size string, key string"


def test_hilbert_neighbours_are_neighbours():
    for dims, bits in ((2, 3), (3, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = packing.hilbert(grid, bits)
        assert sorted(key) == list(range(len(grid)))
        walk = grid[np.argsort(key)].astype(int)
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_packer_never_overfills_and_fills_well():
    r = np.random.default_rng(1)
    p, room = packing.Packer(2048, 64), {}
    for _ in range(20):
        s = r.integers(1, 900, 500)
        for size, c in zip(s, p.place(s)):
            room[c] = room.get(c, 0) + size
    assert max(room.values()) <= 2048
    assert sum(room.values()) / (len(room) * 2048) > 0.98


def test_every_text_or_piece_has_one_container(spark):
    r = random.Random(2)
    rows = [(k, " ".join(r.choice("red green blue tree".split()) for _ in range(r.randrange(60))), None, "x", "y") for k in range(200)]
    rows += [(500, "w " * 250, None, "", ""), (501, "", None, "", ""), (502, None, 7, "", ""), (503, "same text", None, "", ""), (504, "same text", None, "", ""), (505, "x", 100, "", ""), (506, "x " * 200, 200, "", "")]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), "id", "text", "n", capacity=100, window=64, most_open=8).collect()
    size = {}
    parts = {}
    for p in got:
        size[p.container] = size.get(p.container, 0) + p.n_tokens
        parts.setdefault(p.id, []).append((p.piece, p.start, p.n_tokens))
    assert max(size.values()) <= 100 and set(parts) == {x[0] for x in rows if x[1] is not None}
    assert sorted(parts[500]) == [(0, 0, 100), (1, 100, 100), (2, 200, 50)] and parts[501] == [(0, 0, 0)] and parts[505] == [(0, 0, 100)] and len(parts[506]) == 2
    assert all(len(v) == 1 for k, v in parts.items() if k < 500)


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), "id", "text", "n").count() == 0
