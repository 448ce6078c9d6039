"""Growth measured on one texture seen through known maps: a stretch along y that rises along y, a
turn and a shift; all grow from the first snapshot on."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from glimmer.operators import growth, refine, register

SIZE, K = 512, 6
CENTER, SCALE = (SIZE / 2, SIZE / 2), SIZE / 2


def cubic(image, x, y):
    """Catmull-Rom sampling with wrapped edges."""
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)

    def w(t):
        return [-t / 2 + t * t - t**3 / 2, 1 - 2.5 * t * t + 1.5 * t**3, t / 2 + 2 * t * t - 1.5 * t**3, -t * t / 2 + t**3 / 2]

    out = np.zeros(x.shape)
    for j, wy in zip(range(-1, 3), w(y - y0), strict=True):
        for i, wx in zip(range(-1, 3), w(x - x0), strict=True):
            out += wy * wx * image[(y0 + j) % SIZE, (x0 + i) % SIZE]
    return out


def true_map(k, points):
    part = (K - k) / K
    u, v = ((points[:, i] - CENTER[i]) / SCALE for i in (0, 1))
    v = v * (1 + 0.06 * part) + 0.02 * part * v * v
    a = math.radians(0.5) * part
    return np.column_stack([(math.cos(a) * u - math.sin(a) * v) * SCALE + CENTER[0], (math.sin(a) * u + math.cos(a) * v) * SCALE + CENTER[1] + 20 * part])


@pytest.fixture(scope="module")
def snapshots(spark):
    noise = np.random.default_rng(0).normal(0, 1, (SIZE, SIZE))
    f = np.fft.fftfreq(SIZE)
    texture = np.fft.ifft2(np.fft.fft2(noise) * np.exp(-2 * (np.pi * 3) ** 2 * (f[:, None] ** 2 + f**2))).real * 1000 + 50
    y, x = np.mgrid[:SIZE, :SIZE].astype(float)
    points = np.column_stack([x.ravel(), y.ravel()])
    rows = []
    for k in range(K + 1):
        at = true_map(k, points)
        rows.append((k, SIZE, SIZE, cubic(texture, at[:, 0], at[:, 1]).tobytes()))
    return spark.createDataFrame(rows, "snapshot long, height int, width int, pixels binary").repartition(4).cache()


@pytest.fixture(scope="module")
def measured(snapshots):
    return refine.measure(snapshots, region=(80, SIZE - 80, 80, SIZE - 80), patch=96, step=64, sampling=1)


def test_every_snapshot_is_carried_onto_the_last(measured):
    points = np.array([(x, y) for x in np.linspace(120, SIZE - 120, 9) for y in np.linspace(120, SIZE - 120, 9)])
    for k in range(K + 1):
        source = refine.mapped(measured.inverse[k], points)
        miss = np.hypot(*(refine.mapped(measured.forward[k], source) - true_map(k, source)).T)
        assert math.sqrt((miss**2).mean()) < 0.05 and miss.max() < 0.15, k


def test_the_chain_alone_is_rougher(measured):
    points = np.array([(x, y) for x in np.linspace(120, SIZE - 120, 9) for y in np.linspace(120, SIZE - 120, 9)])
    source = refine.mapped(measured.inverse[0], points)
    rough, fine = (np.hypot(*(refine.mapped(m, source) - true_map(0, source)).T).max() for m in (measured.steps[0][0], measured.forward[0]))
    assert fine < rough / 3 and measured.history[0]["rms_px"] > measured.history[-1]["rms_px"]


def test_the_axis_and_the_stretch(measured):
    assert abs(math.degrees(measured.theta) - 90) < 3
    e = 1e-3
    a, b = refine.mapped(measured.forward[0], np.array([(CENTER[0], CENTER[1] - e), (CENTER[0], CENTER[1] + e)]))
    assert (b[1] - a[1]) / (2 * e) - 1 == pytest.approx(0.06, abs=0.004)


@pytest.mark.parametrize("model,parameters", [("affine", 6), ("quadratic", 12), ("growth", 7)])
def test_bases(model, parameters):
    points = np.random.default_rng(0).uniform(0, 100, (50, 2))
    g = refine.displacement_basis(points, model, 0.3, (50, 50), 50.0)
    assert g.shape == (50, 2, parameters) and np.linalg.matrix_rank(g.reshape(100, -1)) == parameters
    # a shift, a turn and a stretch are in each of them
    for field in (points * 0 + [3, -2], points @ [[0, 0.01], [-0.01, 0]], points * 0.02):
        target = field.reshape(-1)
        fit = np.linalg.lstsq(g.reshape(100, -1), target, rcond=None)[0]
        assert np.allclose(g.reshape(100, -1) @ fit, target, atol=1e-8)


def test_half_spectra_give_the_same_shift():
    rng = np.random.default_rng(2)
    f = np.fft.fftfreq(64)
    image = np.fft.ifft2(np.fft.fft2(rng.normal(0, 1, (64, 64))) * np.exp(-60 * (f[:, None] ** 2 + f**2)))
    moved = np.fft.ifft2(np.fft.fft2(image) * np.exp(-2j * np.pi * (2.3 * f[None, :] - 1.6 * f[:, None]))).real
    a, b = refine._spectrum(image.real), refine._spectrum(moved)
    fa, fb = (np.frombuffer(s[0], np.complex64).reshape(64, 33) for s in (a, b))
    dx, dy, height = refine.spectral_shift(fa, fb, 64)
    want = register.shift(image.real, moved)
    assert (dx, dy) == pytest.approx(want[:2], abs=0.011) and height / math.sqrt(a[1] * b[1]) == pytest.approx(want[2], abs=1e-3)
    assert refine._spectrum(np.full((4, 4), np.nan))[2] is False


def test_bad_patches_do_not_pull(spark):
    rng = np.random.default_rng(3)
    points = rng.uniform(0, 100, (60, 2))
    basis = lambda p: refine.displacement_basis(p, "affine", 0.0, (50, 50), 50.0)
    truth = np.vstack([rng.normal(0, 0.02, (3, 6)), np.zeros(6)])
    rows = []
    for a, b in refine.pairs_of(4, (1, 2)):
        d = basis(points) @ (truth[a] - truth[b])
        d[rng.random(60) < 0.15] += 30
        rows += [(a, b, x, y, u, v, 0.9, 1.0, 2.0, 0.3) for (x, y), (u, v) in zip(points.tolist(), d.tolist(), strict=True)]
    got, used = refine.solved(spark.createDataFrame(rows, refine.SHIFTS), 4, basis, 6)
    assert np.allclose(got, truth, atol=1e-6) and used["kept"] < len(rows)


def test_maps_there_and_back(spark):
    m = growth.QuadMap([(260.0, 250.0), (255.0, 3.0), (-4.0, 270.0), (2.0, -1.0), (1.0, 4.0), (-3.0, 6.0)], CENTER, SCALE)
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in rng.uniform(0, SIZE, (200, 2))], "x double, y double")
    fx, fy = growth.final_position(F.col("x"), F.col("y"), m, (1.02, -0.03, 0.05, 0.97), (0.5, -0.25))
    there = df.withColumn("fx", fx).withColumn("fy", fy)
    bx, by = growth.first_position(F.col("fx"), F.col("fy"), m, (1.02, -0.03, 0.05, 0.97), (0.5, -0.25))
    miss = there.select(F.hypot(bx - F.col("x"), by - F.col("y")).alias("d")).agg(F.max("d"), F.count("d")).first()
    assert miss[0] < 1e-6 and miss[1] == 200


def test_a_warped_stack_on_a_larger_canvas(spark):
    y, x = np.mgrid[:40, :50].astype(float)
    frames = spark.createDataFrame([(k, 40, 50, (x + 100 * y + k).tobytes()) for k in range(3)], "frame int, height int, width int, pixels binary")
    moved = [growth.QuadMap([(25.0 + 10 * k, 20.0 - 5 * k), (25.0, 0.0), (0.0, 25.0), (0, 0), (0, 0), (0, 0)], (25.0, 20.0), 25.0) for k in range(3)]
    maps = growth.map_table(spark, moved)
    canvas = register.canvas(maps, 40, 50)
    assert canvas == (0, 69, -10, 39)
    for r in register.warped_stack(frames, maps, canvas).collect():
        image = np.frombuffer(bytes(r.pixels)).reshape(r.height, r.width)
        assert image.shape == (50, 70)
        top, left = 10 - 5 * r.frame, 10 * r.frame
        assert np.allclose(image[top : top + 40, left : left + 50], x + 100 * y + r.frame) and image.sum() == pytest.approx((x + 100 * y + r.frame).sum())


def test_records(tmp_path):
    m = growth.QuadMap([(1.0, 2.0), (3.0, 4.0), (5.0, 6.0), (0.0, 0.0), (0.0, 0.0), (0.0, 0.0)], (1.0, 2.0), 3.0)
    g = refine.Growth([m, m], [m, m], 1.5, [{"pass": 1, "rms_px": 0.1}], [[m, m], [m, m]])
    path = str(tmp_path / "g.json")
    refine.save_growth(path, [0.0, 30.0], g)
    assert refine.load_growth(path) == ([0.0, 30.0], g)
    (tmp_path / "g.json.steps").write_text("[[{")
    times, back = refine.load_growth(path)
    assert back.steps == [] and back.inverse == g.inverse
    (tmp_path / "other.json").write_text('{"kind": "drift"}')
    with pytest.raises(ValueError, match="not a measured growth"):
        refine.load_growth(str(tmp_path / "other.json"))
