"""Linking against a frame-by-frame search over all assignments."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from glimmer.operators import link as L


def brute_assign(cost, lost):
    """Least cost over every set of links, by trying all."""
    sources = sorted({a for a, _ in cost})
    options = [[(None, lost)] + [(b, c) for (a2, b), c in sorted(cost.items()) if a2 == a] for a in sources]
    best, chosen = np.inf, ()
    for pick in itertools.product(*options):
        used = [b for b, _ in pick if b is not None]
        if len(set(used)) == len(used) and sum(c for _, c in pick) < best:
            best, chosen = sum(c for _, c in pick), pick
    return best, [(a, b) for a, (b, _) in zip(sources, chosen, strict=True) if b is not None]


@pytest.mark.parametrize("seed", range(40))
def test_assignments(seed):
    rng = np.random.default_rng(seed)
    n, m = rng.integers(1, 6, 2)
    cost = {(int(a), int(b)): float(rng.uniform(0, 4)) for a in range(n) for b in range(100, 100 + m) if rng.random() < 0.6}
    got = L.assign(cost, 4.0)
    assert len({a for a, _ in got}) == len({b for _, b in got}) == len(got) and all(e in cost for e in got)
    total = sum(cost[e] for e in got) + 4.0 * (len({a for a, _ in cost}) - len(got))
    assert total == pytest.approx(brute_assign(cost, 4.0)[0])


def test_a_large_subnet():
    rng = np.random.default_rng(1)
    n = 150
    cost = {(a, 1000 + b): float(rng.uniform(0, 1)) for a in range(n) for b in range(n)}
    got = L.assign(cost, 1.0)
    assert len(got) == n and sum(cost[e] for e in got) < 5.0
    # no exchange of two targets is cheaper
    at = dict(got)
    for a, b in itertools.combinations(range(n), 2):
        assert cost[a, at[a]] + cost[b, at[b]] <= cost[a, at[b]] + cost[b, at[a]] + 1e-9


def brute_link(points, search, memory):
    """Particle of each point, frame by frame."""
    live, out = {}, {}
    for frame, f in points.sort_values(["frame", "loc"]).groupby("frame"):
        live = {p: v for p, v in live.items() if frame - v[0] <= memory + 1}
        cost = {}
        for i, x, y in zip(f["loc"], f["x"], f["y"], strict=True):
            for p, (_, px, py) in live.items():
                sq = (x - px) ** 2 + (y - py) ** 2
                if sq <= search**2:
                    cost[p, i] = sq
        of = {b: a for a, b in L.assign(cost, search**2)}
        for i, x, y in zip(f["loc"], f["x"], f["y"], strict=True):
            out[i] = of.get(i, i)
            live[out[i]] = (frame, x, y)
    return out


def crowd(seed, n_frames, per_frame, size, skip=0.3):
    rng = np.random.default_rng(seed)
    at = rng.uniform(0, size, (per_frame, 2))
    rows = []
    for k in range(n_frames):
        at = at + rng.normal(0, 0.35, at.shape)
        rows += [(k, x, y) for x, y in at[rng.random(per_frame) > skip]]
    f = pd.DataFrame(rows, columns=["frame", "x", "y"]).sample(frac=1, random_state=seed)
    return f.assign(loc=np.arange(len(f), dtype="int64") * 7 % 100_003, frame=f["frame"].astype("int64"))


@pytest.mark.parametrize("memory", [0, 1, 3])
@pytest.mark.parametrize("size", [4.0, 9.0])
def test_against_frame_by_frame(spark, memory, size):
    points = crowd(int(size), 25, 12, size)
    got = {r["loc"]: r.particle for r in L.link(spark.createDataFrame(points), 1.0, memory).collect()}
    assert got == brute_link(points, 1.0, memory)


@pytest.mark.parametrize("memory", [0, 1, 2, 5])
def test_candidates_without_many_copies(spark, memory):
    """On and off the edges of cells, at negative places and frames, and at the range itself; a copy
    of a point for each neighbouring cell and frame would be 9 times the frames."""
    rng = np.random.default_rng(memory)
    n = 400
    points = pd.DataFrame({"loc": np.arange(n), "frame": rng.integers(-20, 20, n), "x": rng.integers(-12, 12, n) / 4, "y": rng.integers(-12, 12, n) * 0.1})
    points.loc[:99, ["x", "y"]] += 4e6  # far out, where the range is a small part of a number
    points.loc[100:199, ["x", "y"]] = rng.uniform(-4, 4, (100, 2))
    table = spark.createDataFrame(points)
    got = sorted((r.a, r.b, r.gap, r.frame) for r in L.candidates(table, 1.5, memory=memory).collect())
    f, x, y = (points[c].to_numpy() for c in ("frame", "x", "y"))
    near = ((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2 <= 1.5**2) & (f - f[:, None] >= 1) & (f - f[:, None] <= memory + 1)
    assert got == sorted((a, b, f[b] - f[a], f[b]) for a, b in zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True))
    assert L._spread(table, 1.5, memory + 1).count() <= 9 * n  # 9 * (memory + 1) * n before


@pytest.mark.parametrize("kind", ["plain", "crowded"])
def test_points_are_not_broadcast(spark, tmp_path, capsys, kind):
    """A small file may hold many points, and each has copies: the join deals them out, whatever Spark makes of the file's size."""
    spark.createDataFrame(crowd(1, 12, 10, 4.0).assign(movie=1)).write.parquet(f"{tmp_path}/points")
    table = spark.read.parquet(f"{tmp_path}/points")
    if kind == "crowded":  # numbered first, as the queries do
        table = table.withColumn("frame", F.row_number().over(Window.partitionBy("movie", "frame").orderBy("loc")).cast("long"))
    found = L.candidates(table, 1.0, ("movie",), 1)
    found.explain()
    assert "Broadcast" not in capsys.readouterr().out


@pytest.mark.parametrize("few", [0, 10_000])
def test_links_are_not_broadcast(spark, monkeypatch, few):
    """What grows with the points is dealt out in every round, however small it is; only the frames of a round with few of them are not."""
    monkeypatch.setattr(L, "FEW", few, raising=False)
    plans = []
    run = lambda df: df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    cut = L.cut
    monkeypatch.setattr(L, "cut", lambda df: (cut(df), plans.append(run(df)))[0])
    points = crowd(2, 25, 12, 4.0)
    out = L.link(spark.createDataFrame(points), 1.0, 2, least=2)
    got = {r["loc"]: r.particle for r in out.collect()}
    want = pd.Series(brute_link(points, 1.0, 2))
    assert got == want[want.map(want.value_counts()) > 1].to_dict()
    joins = [line for plan in [*plans, run(out)] for line in plan.splitlines() if "Join" in line]
    sent = [line for line in joins if "BroadcastHashJoin" in line]
    assert len(joins) > 9 and all(few and ("LeftSemi" in line or "LeftAnti" in line) and "frame" in line for line in sent)


def test_acquisitions_are_apart(spark):
    parts = [crowd(seed, 12, 10, 4.0).assign(movie=seed) for seed in (1, 2)]
    parts[1]["loc"] += 500_000
    got = {r["loc"]: r.particle for r in L.link(spark.createDataFrame(pd.concat(parts)), 1.0, 2, by=("movie",)).collect()}
    assert got == brute_link(parts[0], 1.0, 2) | brute_link(parts[1], 1.0, 2)


def test_the_stream_form_agrees():
    points = crowd(3, 20, 12, 4.0).sort_values(["frame", "loc"])
    got = L.link_frames(points["frame"].tolist(), points["loc"].tolist(), points[["x", "y"]].to_numpy(), 1.0, 2)
    assert got == brute_link(points, 1.0, 2)


def test_a_long_chain_of_choices(spark):
    """Every frame's choice depends on the one before: two particles on a line, one of them seen
    in each frame, so that the other waits."""
    rows = [(k, k, 0.45 * k, 0.0) for k in range(40)] + [(100 + k, k, 0.45 * k + 0.3 * (-1) ** k, 0.2) for k in range(0, 40, 2)]
    points = pd.DataFrame(rows, columns=["loc", "frame", "x", "y"]).astype({"loc": "int64", "frame": "int64"})
    got = {r["loc"]: r.particle for r in L.link(spark.createDataFrame(points), 1.2, 2).collect()}
    assert got == brute_link(points, 1.2, 2)


def test_nothing_to_link(spark):
    none = spark.createDataFrame([], "loc long, frame long, x double, y double")
    assert L.link(none, 1.0, 2).count() == 0
    one = spark.createDataFrame([(5, 1, 0.0, 0.0)], "loc long, frame long, x double, y double")
    assert [r.particle for r in L.link(one, 1.0, 2).collect()] == [5]
    assert L.link(one, 1.0, 2, least=2).count() == 0
