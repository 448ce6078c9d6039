"""Simulations with known truth and hand-computed cases."""

import json
import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from glimmer.functions import num, scalars
from glimmer.operators import drift, filters, link, populations, register, render, spots, timejoin, tracks
from glimmer.plans import session
from glimmer.sources import sinks, stack, tables
from glimmer.streaming import windows

rng = np.random.default_rng(5)


def test_range_filter_drops_nan_and_ignores_unknown(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (None,)], "a double")
    assert [r.a for r in filters.range_filter(df, {"a": (1.0, None), "b": (0, 1)}).collect()] == [1.0, 2.0]
    assert filters.range_filter(None, {}) is None and filters.range_filter(df, {}) is df
    assert filters.merged_bounds({"a": (1, None)}, {"a": (0, 9)}) == {"a": (1, 9)}
    assert filters.infer_roles(["frame", "x [nm]", "y [nm]", "sigma [nm]", "intensity [photon]", "uncertainty [nm]"])["sigma"] == "sigma [nm]"
    assert [filters.is_sigma(c) for c in ("sigma_x [nm]", "Sigma1 [nm]", "sigma_nm", "uncertainty [nm]")] == [True, True, True, False]


def test_detectable_diffusion():
    d = [num.detectable_diffusion(n, 25.0, 0.03) for n in (3, 8, 30)]
    assert d[0] > d[1] > d[2] and math.isinf(num.detectable_diffusion(2, 25.0, 0.03))
    assert num.detectable_diffusion(8, 50.0, 0.03) == pytest.approx(4 * d[1], rel=1e-6)
    assert abs(num.chi2_sf_even(18, 12) - 0.11569) < 1e-4 and abs(num.gamma_sf(9, 6) - num.chi2_sf_even(18, 12)) < 1e-9


def test_static_p_value(spark):
    rows = [(float(t), n) for n in (2, 3, 7, 30) for t in (0.5, 5, 40)]
    for r in spark.createDataFrame(rows, "t double, n int").withColumn("p", scalars.static_p_value(F.col("t"), F.col("n"))).collect():
        assert r.p == pytest.approx(num.chi2_sf_even(r.t, 2 * (r.n - 1)), abs=1e-9)


def test_nearest_prefers_the_earlier(spark):
    left = spark.createDataFrame([(15.0,), (16.0,), (-5.0,), (99.0,)], "t double")
    right = spark.createDataFrame([(10.0, 1), (20.0, 2)], "r double, v int")
    assert {r.t: r.v for r in timejoin.nearest(left, right, "t", "r", ["v"], 7.0).collect()} == {15.0: 1, 16.0: 2, -5.0: 1, 99.0: 2}


def test_smoother_is_exact_on_a_ramp(spark):
    rec = spark.createDataFrame([(0.5 * i, 3.0 + 0.2 * i, -0.1 * i) for i in range(100)], "t double, dx double, dy double")
    for r in drift.smoothed(rec, 2.0, 0.5).filter("dx IS NOT NULL").collect():
        assert r.dx == pytest.approx(3.0 + 0.4 * r.t, abs=1e-6) and r.dy == pytest.approx(-0.2 * r.t, abs=1e-6)


def test_tabulated_likelihood_is_the_exact_one(spark):
    rows = [(k, int(f), float(x), float(y), 20.0 + k) for k in range(30) for f, x, y in zip(np.cumsum(rng.integers(1, 4, 2 + k % 9)), rng.normal(0, 50, 2 + k % 9), rng.normal(0, 50, 2 + k % 9), strict=True)]
    t = populations.increments(spark.createDataFrame(rows, "particle long, frame int, x_nm double, y_nm double, sigma_nm double"))
    for blur in (0.0, 1 / 6):
        table = populations.likelihood_table(t, 0.03, blur)
        for g in (0, 57, 120):
            exact = populations.log_likelihood(F.col("steps"), F.lit(float(populations.grid()[g])), 0.03, blur)
            assert table.select(F.max(F.abs(exact - F.col("ll")[g]))).first()[0] < 1e-8
    f = np.sin(np.log(populations.grid()) / 3)
    assert f @ populations._between(math.log(0.0123)) == pytest.approx(math.sin(math.log(0.0123) / 3), abs=1e-6)
    assert f @ populations._between(math.log(populations.GRID_MAX)) == pytest.approx(f[-1])


def test_correction_is_reversible(spark):
    locs = spark.createDataFrame([(0, 10.0, 20.0), (7, 1.0, 2.0)], "frame int, x_nm double, y_nm double")
    series = spark.createDataFrame([(i, float(i), -float(i)) for i in range(5)], "frame int, dx double, dy double")
    out = drift.corrected(locs, series, 5)
    assert {(r.frame, r.x_nm, r.outside) for r in out.collect()} == {(0, 10.0, False), (7, -3.0, True)}
    assert drift.corrected(out, series, 5) is out
    assert {(r.x_nm, r.y_nm) for r in drift.uncorrected(out).collect()} == {(10.0, 20.0), (1.0, 2.0)}


def test_rcc_recovers_a_drift(spark):
    n_frames, at = 200, rng.uniform(0, 4000, (150, 2))
    f = np.arange(n_frames)
    rows = []
    for x, y in at:
        on = f[rng.random(n_frames) < 0.3]
        rows += [(int(k), float(x + 0.5 * k + rng.normal(0, 8)), float(y - 0.3 * k + rng.normal(0, 8))) for k in on]
    out = drift.rcc(spark.createDataFrame(rows, "frame int, x_nm double, y_nm double"), n_frames, 50, 20.0, 20.0, 300.0).orderBy("segment").toPandas()
    assert np.abs(out["dx"] - 0.5 * (out["centre"] - out["centre"][0])).max() < 4
    assert np.abs(out["dy"] + 0.3 * (out["centre"] - out["centre"][0])).max() < 4
    line = drift.rcc_per_frame(spark.range(200).select(F.col("id").alias("frame")), spark.createDataFrame(out)).orderBy("frame").toPandas()
    assert line["dx"][0] == line["dy"][0] == 0 and abs(line["dx"][199] - 99.5) < 8


def test_merge(spark):
    rows = [(1, 0, 10.0, 5.0, 10.0, 100.0), (1, 3, 12.0, 5.0, 20.0, 50.0), (2, 1, 0.0, 0.0, 5.0, 7.0), (-1, 4, 1.0, 1.0, 5.0, 1.0)]
    t = spark.createDataFrame(rows, "particle long, frame int, x double, y double, sigma double, photons double")
    out = {r.particle: r for r in tracks.merge(t, t.filter("particle = 1").select("particle")).collect()}
    assert out[1].x == pytest.approx(10.4) and out[1].sigma == pytest.approx(math.sqrt(80)) and out[1].photons == 150 and (out[1].frame, out[1].frame_last, out[1].n_merged) == (0, 3, 2)
    assert out[2].n_merged == 1 and out[-1].n_merged == 1


def test_splat_keeps_the_signal(spark):
    locs = spark.createDataFrame([(10.2, 11.7, 0.8), (20.0, 20.0, 1.5), (31.9, 5.0, 0.5)], "x double, y double, s double")
    total = render.splat(locs.limit(2), 64, 64, 4, F.col("s")).agg(F.sum("value")).first()[0]
    assert total == pytest.approx(2.0, abs=1e-9)
    h = render.histogram(locs, 64, 64, 4)
    assert render.blurred(h, 1.5, 256, 256).agg(F.sum("value")).first()[0] == pytest.approx(3.0, abs=1e-9)
    assert render.rotated(render.rotated(h, 1, 256, 256), 3, 256, 256).exceptAll(h.select("value", "row", "col")).count() == 0


def test_sliding_windows(spark):
    df = render.sliding(spark.range(10).select(F.col("id").alias("frame")), "frame", 0, 9, 4, 3).groupBy("movie_frame").agg(F.min("frame").alias("a"), F.max("frame").alias("b"))
    assert {(r.movie_frame, r.a, r.b) for r in df.collect()} == {(0, 0, 3), (1, 3, 6), (2, 6, 9), (3, 9, 9)}
    assert render.group_count(0, 9, "sliding", 4, 3) == 4 and render.group_count(0, 9, "tumbling", 4) == 3


def spot_frame(at, size=48, amp=300.0, sigma=1.3, bg=10.0):
    y, x = np.mgrid[:size, :size]
    m = sum(amp * np.exp(-((x - a) ** 2 + (y - b) ** 2) / 2 / sigma**2) for a, b in at) + bg
    return rng.poisson(m).astype(float) + 100


def test_localizations(spark):
    at = [(10.3, 12.8), (30.6, 20.1), (22.0, 37.4)]
    frames = spark.createDataFrame([(k, 48, 48, spot_frame(at).tobytes()) for k in range(6)], stack.STACK)
    for backend in ("fast", "mle", "gpu"):
        out = spots.localizations(frames, 800.0, 7, backend).toPandas()
        assert len(out) == 18 and out["frame"].nunique() == 6
        for a, b in at:
            near = out[(abs(out["x"] - a) < 1) & (abs(out["y"] - b) < 1)]
            assert len(near) == 6 and abs(near["x"].mean() - a) < 0.06 and abs(near["photons"].mean() / (2 * math.pi * 300 * 1.69) - 1) < 0.06
    assert spots.detect(frames, 800.0).count() == 18
    assert spots.time_binned(frames, 4).count() == 1 and spots.time_binned(frames, 1) is frames
    y, x = spots.local_maxima(np.pad(np.ones((2, 2)), 10), 5)
    assert (y.tolist(), x.tolist()) == ([10], [10])


def test_link_recovers_walks(spark):
    rows, loc = [], 0
    starts = rng.uniform(0, 200, (40, 2))
    for p, s in enumerate(starts):
        at = s.copy()
        for k in range(20):
            at = at + rng.normal(0, 0.3, 2)
            rows.append((p, loc, k, *map(float, at)))
            loc += 1
    df = spark.createDataFrame(rows, "true int, loc long, frame long, x double, y double")
    for memory in (0, 2):
        out = link.link(df, 3.0, memory, 2).groupBy("particle").agg(F.countDistinct("true").alias("mixed"), F.count(F.lit(1)).alias("n")).collect()
        assert sum(r.n for r in out) == 800 and sum(r.mixed == 1 for r in out) >= 38
    gap = spark.createDataFrame([(0, 0, 0.0, 0.0), (1, 2, 0.5, 0.0)], "loc long, frame long, x double, y double")
    assert link.link(gap, 1.0, 0).select("particle").distinct().count() == 2
    assert link.link(gap, 1.0, 1).select("particle").distinct().count() == 1
    assert sorted(link.assign({(0, 10): 1.0, (0, 11): 2.0, (1, 10): 1.5}, 9.0)) == [(0, 11), (1, 10)]


def test_likelihood_is_that_of_the_dense_normal(spark):
    sigma = np.array([20.0, 30.0, 25.0, 15.0])
    frame = np.array([0, 1, 3, 4])
    x, y = rng.normal(0, 50, 4), rng.normal(0, 50, 4)
    df = spark.createDataFrame([(1, int(f), float(a), float(b), float(s)) for f, a, b, s in zip(frame, x, y, sigma)], "particle long, frame long, x_nm double, y_nm double, sigma_nm double")
    d, tau, r = 0.05, 0.03, 1 / 6
    got = populations.increments(df).select(populations.log_likelihood(F.col("steps"), F.lit(d), tau).alias("v")).first().v
    gap = np.diff(frame)
    c = np.diag(2e6 * d * (gap - 2 * r) * tau + sigma[1:] ** 2 + sigma[:-1] ** 2)
    for i in range(2):
        c[i, i + 1] = c[i + 1, i] = 2e6 * d * r * tau - sigma[i + 1] ** 2
    want = sum(-0.5 * v @ np.linalg.solve(c, v) - 0.5 * np.log(np.linalg.det(c)) - 1.5 * math.log(2 * math.pi) for v in (np.diff(x), np.diff(y)))
    assert got == pytest.approx(want, rel=1e-9)


def test_mixture(spark):
    rows = []
    for p in range(300):
        d = 0.0 if p % 5 < 2 else 0.1
        at = np.cumsum(rng.normal(0, math.sqrt(2e6 * d * 0.03) if d else 0.0, (10, 2)), 0) + rng.normal(0, 25, (10, 2))
        rows += [(p, k, float(a), float(b), 25.0) for k, (a, b) in enumerate(at)]
    df = spark.createDataFrame(rows, "particle long, frame long, x_nm double, y_nm double, sigma_nm double")
    fit, post = populations.fit_populations(df, 0.03, 1, blur=0.0)
    assert fit.d[1] == pytest.approx(0.1, rel=0.15) and fit.fractions[0] == pytest.approx(0.4, abs=0.06)
    wrong = post.filter((F.col("p_immobile") > 0.5) != (F.col("particle") % 5 < 2)).count()
    assert wrong < 15
    assert populations.localization_fraction(post).first()["p_immobile"] == pytest.approx(0.4, abs=0.06)


def test_registration():
    y, x = np.mgrid[:96, :96].astype(float)
    at = rng.uniform(10, 86, (40, 2))
    image = lambda dx, dy: sum(np.exp(-((x - a - dx) ** 2 + (y - b - dy) ** 2) / 8) for a, b in at)
    dx, dy, q = register.shift(image(0, 0), image(1.37, -0.62))
    assert abs(dx - 1.37) < 0.05 and abs(dy + 0.62) < 0.05 and q > 0.8
    s, v = register.line_profile(np.exp(-((x - 48) ** 2) / 2 / 3.0**2), (20, 40), (76, 40), 5)
    assert register.profile_width(s, v) == pytest.approx(2.3548 * 3, rel=0.02)


def test_growth(spark):
    size, n = 160, 3
    at = rng.uniform(0, size, (220, 2))
    y, x = np.mgrid[:size, :size].astype(float)
    truth = np.zeros((n, 7))
    truth[:, 1] = [-0.02, -0.01, 0.0]
    rows = []
    for k in range(n):
        moved = at + register.growth_basis(at[:, 0], at[:, 1], 0.0, (80, 80), 80.0) @ truth[k]
        image = sum(np.exp(-((x - a) ** 2 + (y - b) ** 2) / 6) for a, b in moved)
        rows.append((k, size, size, image.tobytes()))
    snaps = spark.createDataFrame(rows, "snapshot long, height int, width int, pixels binary")
    got, _ = register.measure_growth(snaps, drift.lagged_pairs(spark.range(n).withColumnRenamed("id", "snapshot"), [1, 2]), n, 0.0, 64, 32)
    assert np.abs(got[:, 1] - truth[:, 1]).max() < 0.004


def test_sidecars(spark, tmp_path):
    p = tmp_path / "d.csv"
    p.write_text('# {"kind": "xy_drift", "version": 1}\nt_epoch,dx_px,dy_px,ok\n2,1.0,x,1\n1,0.5,0.1,1\n3,9,9,0\n4,2,2,1\n')
    meta, df = tables.drift_record(spark, str(p))
    assert meta["version"] == 1 and df.filter("dx IS NOT NULL AND dy IS NOT NULL").count() == 2
    with pytest.raises(ValueError, match="holds xy_drift"):
        tables.frame_times(spark, str(p))
    assert tables.companion("run_a_1", ["run_a_x", "run_b"]) == "run_a_x" and tables.companion("run", ["run_a", "run_b"]) is None
    text = "".join(f'"FrameKey-{i}-0-0": {{"ElapsedTime-ms": {31.5 * i}}},' for i in range(10)) + '"FrameKey-10-0-0": {"Elap'
    assert tables.measured_interval(tables.elapsed_times(text)) == pytest.approx(31.5)
    assert tables.json_object('x{"a":"}{"}y', 1) == '{"a":"}{"}'
    assert tables.ome_pixels('<Pixels PhysicalSizeX="100" PhysicalSizeXUnit="nm" TimeIncrement="30" TimeIncrementUnit="ms">') == {"pixel_um": 0.1, "interval_s": 0.03}
    assert tables.merged_metadata(("a", {"interval_s": None}), ("b", {"interval_s": 0.05}))["fps"] == (20.0, "b")


def test_tiff_round_trip(spark, tmp_path):
    image = spark.createDataFrame([(1, 2, 3.5)], "row int, col int, value double")
    sinks.save_render(str(tmp_path / "a.tif"), image, 4, 5, {"k": 1})
    back = stack.stack(spark, str(tmp_path / "a.tif")).first()
    got = np.frombuffer(bytes(back["pixels"])).reshape(4, 5)
    assert got[1, 2] == 3.5 and got.sum() == 3.5 and json.load(open(tmp_path / "a.tif.json")) == {"k": 1}


def test_run_folders_and_export(spark, tmp_path):
    from datetime import datetime

    a, b = (sinks.run_folder(str(tmp_path), "loc", datetime(2026, 1, 2)) for _ in range(2))
    assert a != b
    sinks.export(a, {"t": spark.createDataFrame([], "x int, y int")}, {})
    part = [f for f in os.listdir(f"{a}/data/t.csv") if f.endswith(".csv")]
    assert any(open(f"{a}/data/t.csv/{f}").read().startswith("x,y") for f in part)


def test_session(spark, tmp_path):
    locs = pd.DataFrame({"loc": range(6), "frame": [0, 1, 2, 0, 1, 2], "x": [0, 0.1, 0.2, 50, 50.1, 50.2], "y": 0.0, "photons": [1.0] * 6})
    locs.to_parquet(tmp_path / "l.parquet")
    path = str(tmp_path / "s.json")
    session.write_session(path, {"localizations": str(tmp_path / "l.parquet")}, {"filtered": {"bounds": {"photons": [0, 2]}}, "trajectories": {"search": 1.0}}, ["filtered", "trajectories"], {"filtered": 6, "trajectories": 7})
    made, wrong = session.build(spark, path)
    assert made["trajectories"].select("particle").distinct().count() == 2 and wrong == ["trajectories: 7 expected, 6 found"]
    json.dump({"session": 99}, open(path, "w"))
    with pytest.raises(ValueError, match="newer"):
        session.read_session(path)


def run_stream(q):
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_streams(spark, tmp_path):
    rows = pd.DataFrame({"acquisition": 1, "loc": range(100), "frame": np.arange(100), "particle": 1, "x": np.arange(100) * 0.1, "y": 0.0, "photons": 1.0})
    rows.to_parquet(tmp_path / "a.parquet")
    src = lambda: spark.readStream.schema(spark.read.parquet(str(tmp_path)).schema).parquet(str(tmp_path))
    w = windows.windowed_counts(windows.event_time(src()), 10, late_s=0)
    run_stream(w.writeStream.outputMode("append").format("memory").queryName("closed").start())
    run_stream(w.writeStream.outputMode("update").format("memory").queryName("every").start())
    assert spark.table("every").count() == 10 and spark.table("closed").count() == 9
    series = spark.createDataFrame([(i, 0.5) for i in range(50)], "frame long, dx double")
    run_stream(windows.clamped_drift(src(), series, 50).writeStream.format("memory").queryName("drifted").start())
    assert spark.table("drifted").filter("outside").count() == 50
    run_stream(windows.live_linker(src(), 1.0, 1).writeStream.outputMode("append").format("memory").queryName("linked").start())
    assert spark.table("linked").select("particle").distinct().count() == 1 and spark.table("linked").count() == 100


def test_selection(spark, tmp_path):
    from glimmer.operators import selection as sel

    assert sel.camera_map({"camera_map": [1, 0, 0, 1]}, None) == ([1, 0, 0, 1], "the record's own map")
    assert sel.camera_map({"orientation": 1, "frame_px": 512}, {"orientation": 1, "frame_px": 1024, "matrix": [2.0, 0, 0, 2.0]})[0] == [1.0, 0, 0, 1.0]
    assert sel.camera_map({"orientation": 1}, {"orientation": 2})[0] is None
    out, notes = sel.settings_from({"a": {"min_distance_nm": 500, "pixel_size_nm": 100, "box": 7}}, by_hand=False)
    assert out == {"distance_um": 0.5, "box": 7} and len(notes) == 2
    df = spark.createDataFrame([(0, 0, 1.0, 1.0)], "loc long, frame long, x double, y double")
    assert sel.resolved({"x": (0, 1), "z": (0, 1)}, df) == ({"x": (0, 1)}, ["z"]) and sel.resolved({"x": (0, 1)}, None) == ({}, ["x"])
    assert sel.previous_run(["analysis_2", "analysis_10", "x"]) == "analysis_10" and sel.previous_run(["analysis_2", "2026-01-01_100000_loc"]) == "2026-01-01_100000_loc"
    assert sel.layer_name("mobile", True) == "smlm_render_mobile_merged"
    cache = sel.LinkCache(str(tmp_path))
    a, b = cache.link(df, 1.0), cache.link(df, 1.0)
    assert a.inputFiles() == b.inputFiles() and cache.key(df, search=1.0) != cache.key(df, search=2.0)
    for name, at in (("one", 0), ("other", 100)):  # two tables of one schema
        spark.createDataFrame([(at + k, k, 1.0, 1.0) for k in range(3)], "loc long, frame long, x double, y double").write.parquet(str(tmp_path / name))
    one, other = (cache.link(spark.read.parquet(str(tmp_path / name)), 1.0) for name in ("one", "other"))
    assert {r.particle for r in one.collect()} == {0} and {r.particle for r in other.collect()} == {100}
    tip = sel.tooltip(spark.createDataFrame([(1, 0.5, 2)], "particle long, d double, n long"), spark.createDataFrame([(1, 3), (1, 7)], "particle long, frame long"), 1).first()
    assert (tip.start, tip.end, tip.span, tip.points, tip.d) == (3, 7, 5, 2, 0.5)
    t = spark.createDataFrame([(1, 0, 1.0, 1.0, 5.0, 9.0), (1, 1, 1.0, 1.0, 5.0, 9.0), (2, 0, 2.0, 2.0, 5.0, 9.0)], "particle long, frame long, x double, y double, sigma double, photons double")
    shown = sel.render_table(t, tracks.merge(t, t.filter("particle = 1").select("particle")))
    assert shown.agg(F.sum("weight")).first()[0] == 3.0 and shown.count() == 2


def test_growth_record(spark, tmp_path):
    from glimmer.operators import growth

    m = growth.identity((5.0, 5.0), 10.0)
    n = growth.QuadMap([(5.5, 5.0), (11.0, 0.0), (0.0, 10.0), (0.0, 0.0), (0.0, 0.0), (0.0, 0.0)], (5.0, 5.0), 10.0)
    growth.save_record(str(tmp_path / "g.json"), [0.0, 10.0], [m, n], {"rms": 0.1})
    times, maps, stats = growth.load_record(str(tmp_path / "g.json"))
    assert stats == {"rms": 0.1} and growth.map_at(times, maps, 5.0).coef[1] == (10.5, 0.0) and growth.map_at(times, maps, 99.0) == n
    df = spark.createDataFrame([(1, 0, 5.0, 5.0), (1, 1, 7.0, 6.0)], "particle long, frame long, x double, y double")
    rows = growth.mapped_rows(df, n).orderBy("frame").collect()
    assert rows[1].x_final - rows[0].x_final == pytest.approx(2.2) and rows[1].x_local - rows[0].x_local == pytest.approx(2.0)
    along, across = scalars.strain(n.jacobian(F.col("x"), F.col("y")), 0.0)
    r = df.select(along.alias("a"), across.alias("b"), scalars.nice_length(F.lit(170.0)).alias("n"), scalars.blur_coefficient(F.lit(2.0)).alias("c"), scalars.time_label(F.lit(3725.0), F.lit(4000.0)).alias("t")).first()
    assert r.a == pytest.approx(0.1) and abs(r.b) < 1e-12 and r.n == 200.0 and r.c == pytest.approx(1 / 6) and r.t == "01:02:05"
    image = np.zeros((20, 20))
    image[5, 5] = 1.0
    frames = spark.createDataFrame([(k, 20, 20, image.tobytes()) for k in range(4)], stack.STACK)
    moved = register.virtual_shift(frames, spark.createDataFrame([(k, 2.0, 1.0) for k in range(4)], "frame int, dx double, dy double")).first()
    assert np.frombuffer(bytes(moved["pixels"])).reshape(20, 20)[6, 7] == 1.0
    assert {r.n for r in register.averaged(frames, 3).collect()} == {3, 1}
    angle, coherence = register.principal_axis(np.sin(np.arange(40))[None, :] * np.ones((40, 1)))
    assert abs(abs(angle) - math.pi / 2) < 0.05 and coherence > 0.9
    x, y = np.meshgrid(np.arange(30.0), np.arange(30.0))
    back = register.warp(x + 2 * y, np.array(m.coef), (5.0, 5.0), 10.0)
    assert np.allclose(back, x + 2 * y)


def test_projection(spark):
    movie = spark.createDataFrame([(0, 1, 1, 2.0), (1, 1, 1, 3.0)], "movie_frame int, row int, col int, value double")
    assert sinks.projection(movie).first()["value"] == 5.0 and sinks.projection(movie, True).first()["value"] == 3.0


@pytest.mark.parametrize("drawn,tile", [(16_384, 256), (1, 256), (20, 130)])
def test_splat_against_a_plain_sum(spark, monkeypatch, drawn, tile):
    from glimmer.operators import render

    monkeypatch.setattr(render, "DRAWN", drawn)
    monkeypatch.setattr(render, "TILE", tile)
    monkeypatch.setattr(render, "TOGETHER", 90)

    rows = [(int(k), float(rng.uniform(-2, 42)), float(rng.uniform(-2, 32)), float(s), float(w)) for k, s, w in zip(rng.integers(0, 2, 300), rng.choice([0.1, 0.7, 2.5, 40.0], 300), rng.uniform(0, 3, 300), strict=True)]
    rows += [(0, None, 1.0, 1.0, 1.0), (0, 1.0, 1.0, float("nan"), 1.0), (1, 5.0, 5.0, None, 2.0), (1, 5.0, 5.0, 1.0, None)]
    df = spark.createDataFrame(rows, "m int, x double, y double, s double, w double").repartition(3)
    want = np.zeros((2, 60, 80))
    for m, x, y, s, w in rows:
        if x is None or w is None:
            continue
        fx, fy = (x + 0.5) * 2, (y + 0.5) * 2
        s = min(max(s * 2 if s is not None and s == s else 0.5, 0.5), 64 / 3)
        r = math.ceil(3 * s)
        ax, ay = math.floor(fx) + np.arange(-r, r + 1), math.floor(fy) + np.arange(-r, r + 1)
        gx, gy = np.exp(-((ax + 0.5 - fx) ** 2) / (2 * s * s)), np.exp(-((ay + 0.5 - fy) ** 2) / (2 * s * s))
        full = w * gy[:, None] * gx[None, :] / gx.sum() / gy.sum()
        oy, ox = (ay >= 0) & (ay < 60), (ax >= 0) & (ax < 80)
        want[m][np.ix_(ay[oy], ax[ox])] += full[np.ix_(oy, ox)]
    got = np.zeros_like(want)
    for r in render.splat(df, 40, 30, 2, F.col("s"), F.col("w"), ("m",)).collect():
        got[r.m, r.row, r.col] = r.value
    assert np.allclose(got, want, atol=1e-9)
    assert render.splat(df.limit(0), 40, 30, 2, F.col("s")).count() == 0


def test_thin_windows_are_bridged(spark):
    rows = [(float(t), 0.1 * t, -0.2 * t) for t in [*range(0, 50, 5), *range(500, 550, 5)]]
    record = spark.createDataFrame(rows, "t double, dx double, dy double")
    out = drift.smoothed(record, 5.0, 5.0).orderBy("k").collect()
    assert [r.k for r in out] == list(range(len(out))) and all(abs(r.dx - 0.1 * r.t) < 1e-6 and abs(r.dy + 0.2 * r.t) < 1e-6 for r in out[:-1])
    plain = drift.smoothed(record, 0.0, 5.0).filter("t = 20").first()
    assert plain.dx == pytest.approx(2.0)
    lone = [(float(t), 0.0, 0.0) for t in [*range(0, 50, 5), *range(2000, 2050, 5)]] + [(1000.0, 5.0, -5.0)]
    got = {r.t: (r.dx, r.dy) for r in drift.smoothed(spark.createDataFrame(lone, "t double, dx double, dy double"), 20.0, 5.0).collect()}
    assert got[1000.0] == (5.0, -5.0) and got[500.0][0] == pytest.approx(5 * (500 - 45) / (1000 - 45)) and got[1500.0][0] == pytest.approx(2.5)
    raw = drift.smoothed(spark.createDataFrame([(0.0, 1.0, 0.0), (10.0, 3.0, 0.0)], "t double, dx double, dy double"), 0.0, 2.5)
    assert sorted((r.t, r.dx) for r in raw.collect()) == [(0.0, 1.0), (2.5, 1.5), (5.0, 2.0), (7.5, 2.5), (10.0, 3.0), (12.5, 3.0)]


def test_bad_pairs_are_left_out(spark):
    true = np.array([[0, 0], [1, 2], [3, -1], [5, 5.0]])
    ends = np.array([(a, b) for a in range(4) for b in range(a)])
    shifts = np.array([true[b] - true[a] for a, b in ends])
    shifts[2] += 50
    assert np.allclose(drift.solve_pairs(ends, shifts, 4, 1.0), true)
    with pytest.raises(ValueError, match="not connected"):
        drift.solve_pairs(np.array([(0, 1)]), np.zeros((1, 2)), 3, 1.0)
    one = drift.rcc_per_frame(spark.range(3).select(F.col("id").alias("frame")), spark.createDataFrame([(0, 1.0, 2.0, 3.0)], "segment int, centre double, dx double, dy double"))
    assert {(r.dx, r.dy) for r in one.collect()} == {(0.0, 0.0)}


def test_ranges_and_rescaled_settings(spark):
    from glimmer.operators import render

    with pytest.raises(ValueError, match="past its end"):
        render.fixed_range(spark.range(3).withColumnRenamed("id", "frame"), "frame", 5, 4)
    assert tracks.binned_settings(4, 100.0, 20.0) == (400.0, 5.0) and tracks.binned_settings(2, 400.0, 5.0, 4) == (200.0, 10.0) and tracks.binned_settings(1, 400.0, 5.0, 4) == (100.0, 20.0)
    assert tables.json_object('{"a": 1', 0) is None and tables.json_object('{"a": {"b": "}"}} x', 0) == '{"a": {"b": "}"}}'
