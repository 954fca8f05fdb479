"""Layouts of circles: nothing overlaps, areas follow sizes, children lie within their parents."""

from __future__ import annotations

import numpy as np
import pytest

from kindred.operators import circles


def apart(x, y, r):
    room = np.hypot(x[:, None] - x, y[:, None] - y) - (r[:, None] + r)
    np.fill_diagonal(room, 0)
    return room.min(initial=0) >= -1e-6 * r.max(initial=1)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 7, 30, 400])
@pytest.mark.parametrize("kind", ["equal", "mixed", "steep"])
def test_circles_are_packed(n, kind):
    rng = np.random.default_rng(n)
    r = {"equal": np.ones(n), "mixed": np.sqrt(rng.integers(1, 100, n)), "steep": np.exp(rng.normal(0, 2, n))}[kind]
    x, y, whole = circles.packed(r)
    assert apart(x, y, r) and (np.hypot(x, y) + r <= whole * (1 + 1e-9)).all()
    if n == 1:
        assert (x[0], y[0], whole) == (0, 0, r[0])
    if n >= 30 and kind != "steep":
        assert (r**2).sum() > 0.6 * whole**2


def test_layout(spark):
    rng = np.random.default_rng(1)
    rows = [(f"t{rng.integers(4)}", f"d{rng.integers(3)}", f"s{rng.integers(12)}", int(rng.integers(1, 60))) for _ in range(150)]
    rows += [(None, "d1", "s1", 5), ("t1", "d1", None, 5), ("t1", "d9", "none", 0)]
    got = circles.layout(spark.createDataFrame(rows, "tissue string, disease string, study string, size int"), ["tissue", "disease"], "study").toPandas()
    sizes: dict = {}
    for *key, size in rows[:150]:
        sizes[tuple(key)] = sizes.get(tuple(key), 0) + size
    leaves = got[got["depth"] == 3]
    area = {tuple(k): r * r for *k, r in leaves[["tissue", "disease", "study", "r"]].itertuples(index=False)}
    ratio = np.array([area[k] / sizes[k] for k in sizes])
    assert set(area) == set(sizes) and np.allclose(ratio, ratio[0])
    assert set(got.loc[got["depth"] == 1, "tissue"]) == {"t0", "t1", "t2", "t3"} and got.loc[got["depth"] < 3, "study"].isna().all()
    parents = {(): (0.0, 0.0, 1.0)} | {tuple(c for c in key if isinstance(c, str)): place for *key, place in zip(got["tissue"], got["disease"], got["study"], zip(got["x"], got["y"], got["r"]))}
    for key, (x, y, r) in parents.items():
        if key:
            px, py, pr = parents[key[:-1]]
            assert np.hypot(x - px, y - py) + r <= pr * (1 + 1e-6)
    for depth in (1, 2, 3):
        level = got[got["depth"] == depth]
        assert apart(*(level[c].to_numpy() for c in "xyr"))
    none = circles.layout(spark.createDataFrame(rows[150:], "tissue string, disease string, study string, size int"), ["tissue", "disease"], "study")
    assert none.count() == 0
