"""Averages of moving stacks against plain sums, and small rules of movies and tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glimmer.operators import filters, register, render
from glimmer.sources.stack import STACK

rng = np.random.default_rng(3)


def test_blocks(spark):
    movie = rng.uniform(0, 100, (23, 6, 5))
    frames = spark.createDataFrame([(k, 6, 5, movie[k].tobytes()) for k in range(23)], STACK).repartition(5)
    for first, last, every, block in ((0, None, 1, 4), (3, 20, 2, 3), (0, 22, 1, 60)):
        chosen = list(range(first, (22 if last is None else last) + 1, every))
        blocks = [chosen[i : i + block] for i in range(0, len(chosen), block)]
        got = register.averaged(frames, block, first, last, every).orderBy("block").collect()
        assert [(r.n, r.middle) for r in got] == [(len(b), b[len(b) // 2]) for b in blocks]
        for r, b in zip(got, blocks, strict=True):
            assert np.allclose(np.frombuffer(bytes(r.pixels)).reshape(6, 5), movie[b].mean(0))


@pytest.mark.parametrize("tile", [4, 512])
def test_a_drifting_stack(spark, monkeypatch, tile):
    monkeypatch.setattr(register, "MEAN_TILE", tile)
    n, h, w = 14, 9, 11
    movie = rng.uniform(0, 100, (n, h, w))
    shifts = [(k, 0.5 * k, float(-(k // 4))) for k in range(n)]
    frames = spark.createDataFrame([(k, h, w, movie[k].tobytes()) for k in range(n)], STACK).repartition(3)
    maps = register.shift_maps(spark.createDataFrame(shifts, "frame int, dx double, dy double"))
    extent = register.canvas(maps, h, w)
    x0, x1, y0, y1 = extent
    assert extent == (0, 17, -3, 8)
    total, weight = np.zeros((y1 - y0 + 1, x1 - x0 + 1)), np.zeros((y1 - y0 + 1, x1 - x0 + 1))
    for i in range(0, n, 4):
        some = list(range(i, min(i + 4, n)))
        _, dx, dy = shifts[some[len(some) // 2]]
        mean = movie[some].mean(0)
        for r in range(total.shape[0]):
            for c in range(total.shape[1]):
                y, x = r + y0 - dy, c + x0 - dx
                if 0 <= y <= h - 1 and 0 <= x <= w - 1:
                    a, b = min(int(y), h - 2), min(int(x), w - 2)
                    u, v = y - a, x - b
                    value = (mean[a, b] * (1 - v) + mean[a, b + 1] * v) * (1 - u) + (mean[a + 1, b] * (1 - v) + mean[a + 1, b + 1] * v) * u
                    total[r, c] += value * len(some)
                    weight[r, c] += len(some)
    got = np.full(total.shape, np.nan)
    for r in register.moved_average(frames, maps, extent, 4).collect():
        got[r.top : r.top + r.height, r.left : r.left + r.width] = np.frombuffer(bytes(r.pixels)).reshape(r.height, r.width)
    want = np.where(weight > 0, total / np.maximum(weight, 1), np.nan)
    assert np.allclose(got, want, equal_nan=True) and np.isnan(got).any()


def test_movie_rules(spark):
    movie = spark.createDataFrame([(1, 5), (7, 2)], "movie_frame int, n long")
    assert [tuple(r) for r in render.forced_groups(movie, 4).orderBy("movie_frame").collect()] == [(0, 0), (1, 5), (2, 0), (3, 0)]
    assert render.frame_interval(0.03, 5) == pytest.approx(0.15) and render.frame_interval(0.03, 0) == 0.03


def test_tables_one_after_another(spark):
    a = spark.createDataFrame([(1, "a0"), (0, "a1"), (1, "a2")], "frame int, name string").coalesce(1)
    b = spark.createDataFrame([(0, "b0", 1.0), (1, "b1", 2.0)], "frame int, name string, more double").coalesce(1)
    out = filters.concatenated([a, b])
    assert [r.name for r in out.collect()] == ["a1", "b0", "a0", "a2", "b1"]
    assert [r.name for r in out.filter(F.col("frame") == 1).orderBy("frame", "part", "place").collect()] == ["a0", "a2", "b1"]
