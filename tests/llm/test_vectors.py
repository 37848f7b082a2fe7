import numpy as np
import pytest

from veilmark.llm import lattice_dedup, pivot_search

SCHEMA = "frame_idx long, hist array<double>, score string"
NAN, INF = float("nan"), float("inf")
ODD = [(900, None), (901, []), (902, [NAN, 1.0]), (903, [INF, 1.0]), (904, [0.0, 0.0]), (None, [1.0, 0.0])]


def frame(spark, rows):
    return spark.createDataFrame([(i, h, "x") for i, h in rows], SCHEMA)


def brute_top(rows, asked, k):
    sound = [(i, np.floor(256 * np.array(h))) for i, h in rows if i is not None and h and all(np.isfinite(h))]
    out = []
    for q, v in [x for x in sound if asked(x[0])]:
        best = sorted((-int(v @ w), i) for i, w in sound if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("n, copies", [(3, 0), (400, 150)])
def test_search_equals_brute_force(spark, monkeypatch, n, copies):
    monkeypatch.setattr(pivot_search, "SHARD_ROWS", 32)
    monkeypatch.setattr(pivot_search, "QUERY_BLOCK", 4)
    draw = np.random.default_rng(n)
    rows = [(i, draw.normal(0, 1, 2).tolist()) for i in range(n)] + [(1000 + i, [0.5, -0.25]) for i in range(copies)] + ODD
    frames = frame(spark, rows)
    got = pivot_search.nearest_frames(frames, frames.where("frame_idx % 10 = 0"))
    assert got.columns == ["query_id", "rank", "frame_idx", "score"]
    assert sorted(map(tuple, got.collect())) == brute_top(rows, lambda i: i % 10 == 0, 5)


def test_search_of_nothing(spark):
    none = frame(spark, [])
    assert pivot_search.nearest_frames(none, none).count() == 0
    only_odd = frame(spark, ODD[:4])
    assert pivot_search.nearest_frames(only_odd, only_odd).count() == 0


def test_lattice_points_are_nearest():
    draw = np.random.default_rng(2).normal(0, 2, (500, 8))
    near = lattice_dedup.nearest_point(draw)
    gap = ((draw - near) ** 2).sum(axis=1)
    assert len(np.unique(lattice_dedup.ROOTS, axis=0)) == 240
    assert (gap[:, None] <= ((draw[:, None] - near[:, None] - lattice_dedup.ROOTS) ** 2).sum(axis=2) + 1e-9).all()


def test_recall_at_the_threshold():
    draw = np.random.default_rng(4)
    a = draw.normal(size=(1000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    z = draw.normal(size=(1000, 64))
    z -= (z * a).sum(axis=1)[:, None] * a
    b = 0.951 * a + np.sqrt(1 - 0.951**2) * z / np.linalg.norm(z, axis=1)[:, None]
    x, y = lattice_dedup.cells(a), lattice_dedup.cells(b)
    met = [((x[:, t, :1] == y[:, t]).any(axis=1) | (y[:, t, :1] == x[:, t]).any(axis=1)) for t in range(lattice_dedup.TABLES)]
    assert np.any(met, axis=0).mean() > 0.97


@pytest.mark.parametrize("block", [8, 1024])
def test_near_copies_equal_brute_force(spark, block):
    draw = np.random.default_rng(7)
    base = draw.normal(size=(30, 16))
    rows = [(i, base[i].tolist()) for i in range(30)]
    rows += [(100 + i, (base[0] + draw.normal(size=16) * 0.05).tolist()) for i in range(60)]
    rows += [(200 + i, (3 * base[1]).tolist()) for i in range(20)] + ODD + [(904, [0.0, 0.0])]
    got = {r["frame_idx"]: r for r in lattice_dedup.near_copies(frame(spark, rows), block=block).collect()}
    units = {i: np.array(h) / np.linalg.norm(h) for i, h in rows if i is not None and h and np.isfinite(h).all() and any(h)}
    link = {i: {j for j in units if j != i and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.95} for i in units}
    for i in units:
        reach, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()] - reach:
                reach.add(j)
                todo.append(j)
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(link[i]), min(reach), min(reach) == i)
    assert (got[900]["n_links"], got[900]["component_id"], got[900]["kept"]) == (0, 900, True)
    assert (got[None]["component_id"], got[None]["kept"]) == (None, False)
    assert sum(1 for r in rows) == lattice_dedup.near_copies(frame(spark, rows), block=block).count()


def test_near_copies_of_nothing(spark):
    assert lattice_dedup.near_copies(frame(spark, [])).count() == 0
