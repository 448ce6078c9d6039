"""Views against a plain array form of the same rules."""

import numpy as np
import pytest

from glimmer.operators import compose as C

rng = np.random.default_rng(8)


def table(spark, image):
    return spark.createDataFrame([(int(r), int(c), float(v)) for (r, c), v in np.ndenumerate(image) if v == v], "row int, col int, value double")


def plain(layers, images, box, pixel):
    """The composite over arrays, pixel by pixel."""
    h, w = round((box[2] - box[0]) / pixel), round((box[3] - box[1]) / pixel)
    out = np.zeros((h, w, 3))
    for layer, image in zip(layers, images, strict=True):
        inverse = np.linalg.inv(layer.linear)
        for r in range(h):
            for c in range(w):
                y, x = inverse @ (np.array([box[0] + (r + 0.5) * pixel, box[1] + (c + 0.5) * pixel]) - layer.offset)
                if not (0 <= y <= layer.height - 1 and 0 <= x <= layer.width - 1):
                    continue
                if layer.smooth:
                    i, j = min(int(y), layer.height - 2), min(int(x), layer.width - 2)
                    u, t = y - i, x - j
                    v = (image[i, j] * (1 - t) + image[i, j + 1] * t) * (1 - u) + (image[i + 1, j] * (1 - t) + image[i + 1, j + 1] * t) * u
                else:
                    v = image[int(np.floor(y + 0.5)), int(np.floor(x + 0.5))]
                low, high = layer.limits
                v = np.clip((v - low) / ((high - low) or 1), 0, 1) ** layer.gamma
                stops = np.array(layer.ramp, float)
                colour = np.array([np.interp(v * (len(stops) - 1), np.arange(len(stops)), stops[:, k]) for k in range(3)])
                a, below = layer.opacity, out[r, c].copy()
                out[r, c] = {"additive": below + colour * a, "minimum": np.minimum(below, colour), "opaque": colour, "translucent": below * (1 - a) + colour * a}[layer.blending]
    return np.clip(out, 0, 1)


def shown(view, h, w):
    out = np.zeros((h, w, 3))
    for r in view.collect():
        out[r.row, r.col] = (r.r, r.g, r.b)
    return out


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 3, 0), (3, 0, 1)])
def test_layers_in_order(spark, order):
    turn = ((0.8, -0.6), (0.6, 0.8))
    images = [rng.uniform(0, 10, s) for s in ((9, 12), (5, 6), (7, 7), (10, 10))]
    layers = [
        C.Layer(table(spark, images[0]), 9, 12, (0, 10), [(0, 0, 0), (1, 0, 0.5)], offset=(0.5, 0.5), blending="additive"),
        C.Layer(table(spark, images[1]), 5, 6, (2, 8), [(0, 1, 0), (0, 0, 1), (1, 1, 1)], ((2.0, 0.0), (0.0, 2.0)), (1.0, 1.0), gamma=1.7, opacity=0.35, smooth=True),
        C.Layer(table(spark, images[2]), 7, 7, (0, 5), [(1, 1, 0), (0.2, 0.3, 1)], turn, (4.03, 3.01), blending="minimum"),
        C.Layer(table(spark, images[3]), 10, 10, (5, 5), [(0.3, 0.6, 0.9)], ((0.5, 0.0), (0.0, 0.5)), (3.25, 4.25), blending="opaque"),
    ]
    box = (0.0, 0.0, 11.0, 13.0)
    some = [layers[i] for i in order]
    view, pixel = C.composite(some, box, 0.5)
    assert np.allclose(shown(view, 22, 26), plain(some, [images[i] for i in order], box, 0.5), atol=1e-9) and pixel == 0.5


def test_boxes_and_pixels(spark):
    one = table(spark, np.ones((4, 6)))
    a = C.Layer(one, 4, 6, (0, 1), offset=(0.0, 0.0))
    b = C.Layer(one, 4, 6, (0, 1), linear=((0.5, 0.0), (0.0, 0.5)), offset=(10.0, 20.0))
    assert C.layers_box([a, b]) == (-0.5, -0.5, 11.75, 22.75)
    view, pixel = C.composite([a, b])
    assert pixel == 0.5 and view.count() == 6 * 10 + 3 * 5
    _, coarse = C.composite([a, b], most=100)
    assert coarse > 0.5 and round(12.25 / coarse) * round(23.25 / coarse) <= 121
    with pytest.raises(ValueError, match="no layer"):
        C.composite([C.Layer(one, 4, 6, (0, 1), opacity=0.0)])
    with pytest.raises(ValueError, match="unknown blending"):
        C.composite([C.Layer(one, 4, 6, (0, 1), blending="average")])


def test_values_that_are_missing(spark):
    image = np.array([[1.0, np.nan], [np.nan, 1.0]])
    under = C.Layer(table(spark, np.ones((2, 2))), 2, 2, (0, 1), [(0, 0, 0), (0, 1, 0)], offset=(0.5, 0.5))
    over = C.Layer(table(spark, image), 2, 2, (0, 1), [(0, 0, 0), (1, 0, 0)], offset=(0.5, 0.5), blending="opaque", background=float("nan"))
    got = shown(C.composite([under, over], (0, 0, 2, 2), 1.0)[0], 2, 2)
    assert got.tolist() == [[[1, 0, 0], [0, 1, 0]], [[0, 1, 0], [1, 0, 0]]]


def test_ramps_and_8_bits(spark):
    table_ = C.ramp_table([(1.0, 0.5, 0.0)])
    assert len(table_) == 256 and table_[0] == (0, 0, 0) and table_[255] == (255, 127, 0) and table_[100] == (100, 50, 0)
    image = spark.createDataFrame([(0, 0, -5.0), (0, 1, 5.0), (0, 2, 99.0)], "row int, col int, value double")
    assert [(r.r, r.g, r.b) for r in C.colourised(image, 0, 10, [(1.0, 1.0, 1.0)]).orderBy("col").collect()] == [(0, 0, 0), (127, 127, 127), (255, 255, 255)]
    assert {r.r for r in C.colourised(image, 3, 3, [(1.0, 1.0, 1.0)]).collect()} == {0}


def test_resampling(spark):
    image = rng.uniform(0, 1, (7, 9))
    got = np.full((24, 20), np.nan)
    for r in C.resampled(table(spark, image), (7, 9), (12, 10), 2, (-0.5, 1.5), (1.5, 0.8), (0.4, -0.2)).collect():
        got[r.row, r.col] = r.value
    rows = np.clip(np.round((-0.5 + (np.arange(24) + 0.5) / 2 - 0.4) / 1.5).astype(int), 0, 6)
    cols = np.clip(np.round((1.5 + (np.arange(20) + 0.5) / 2 + 0.2) / 0.8).astype(int), 0, 8)
    assert np.array_equal(got, image[rows][:, cols])


def test_geometry():
    assert C.layer_transform(10, scale=(2.0, 1.0), translate=(5.0, 0.0)) == ((0.2, 0.1), (5.0 + 2 * (-0.5 + 0.05), -0.5 + 0.05))
    assert C.box_range((1.0, 2.0, 3.0, 5.0), (10, 10), 2) == (3, 7, 5, 11)
    assert C.box_range((3.0, 5.0, 1.0, 2.0), (10, 10), 2) == (3, 7, 5, 11)
    assert C.box_range((-9.0, -9.0, -8.0, 99.0), (10, 10), 2) == (0, 1, 0, 20)
    assert C.box_range((50.0, 50.0, 60.0, 60.0), (10, 10), 2) == (19, 20, 19, 20)
