"""Growth of a tissue measured from its snapshots: a chain of rough maps, then passes that warp
every snapshot into the last one's geometry, register patches of many pairs there, solve for what
is left in every map together, and compose it with the map.

Spark holds the images and the patches.  A snapshot is filtered once, and in each pass warped and
transformed once, patch by patch; the spectra of a patch of all snapshots meet in one task, which
registers every pair there, so a spectrum is shuffled once however many pairs it is in.  The normal
equations of the correction are summed by pair; what comes to the driver is a block of them for
each pair of snapshots and the six coefficients of each map.

Positions are in pixels (x, y).  ``d`` of a pair (a, b) is how far the content of b is moved
against that of a.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.operators.growth import QuadMap
from glimmer.operators.register import bilinear, growth_basis, principal_axis, quad_terms, robust_solve, shift, wall_filter
from glimmer.session import cut

#: Correlation below which a patch is not used, and texture against the median patch.
LEAST_QUALITY, LEAST_TEXTURE = 0.3, 0.25
#: A pass whose corrections are smaller (px), or not smaller than this share of the last, is the last.
CONVERGED, STALLED = 0.01, 0.7
#: Walls that are at least so coherent give the axis; else the largest strain does.
LEAST_COHERENCE = 0.25
#: Rounds of down-weighting, and multiples of the spread at which it begins and at which rows are left out.
ROUNDS, SOFT, HARD = 4, 1.5, 4.0

BANK = "snapshot long, x double, y double, usable boolean, energy double, xx double, yy double, xy double, spectrum binary"
SHIFTS = "a long, b long, x double, y double, dx double, dy double, quality double, xx double, yy double, xy double"


@dataclass
class Growth:
    """Maps of every snapshot to the last and back, the axis, and what each pass did."""

    forward: list[QuadMap]
    inverse: list[QuadMap]
    theta: float
    history: list[dict] = field(default_factory=list)
    #: Forward maps after the chain and after each pass.
    steps: list[list[QuadMap]] = field(default_factory=list)


# --- maps -------------------------------------------------------------------------------------


def fitted_map(source: np.ndarray, target: np.ndarray, center: tuple[float, float], scale: float) -> QuadMap:
    coef = np.linalg.lstsq(quad_terms(source[:, 0], source[:, 1], center, scale), target, rcond=None)[0]
    return QuadMap([(float(a), float(b)) for a, b in coef], center, scale)


def mapped(m: QuadMap, points: np.ndarray) -> np.ndarray:
    return quad_terms(points[:, 0], points[:, 1], m.center, m.scale) @ np.asarray(m.coef)


def displacement_basis(points: np.ndarray, model: str, theta: float, center: tuple[float, float], scale: float) -> np.ndarray:
    """(n, 2, parameters): growth has 7, affine 6, quadratic 12."""
    if model == "growth":
        return growth_basis(points[:, 0], points[:, 1], theta, center, scale)
    terms = quad_terms(points[:, 0], points[:, 1], center, scale)[:, : {"affine": 3, "quadratic": 6}[model]]
    return scale * np.einsum("nm,ij->nijm", terms, np.eye(2)).reshape(len(points), 2, -1)


def grid(region: tuple[int, int, int, int], patch: int, step: int) -> np.ndarray:
    """Centres of the patches that fit into (x0, x1, y0, y1)."""
    x0, x1, y0, y1 = region
    xs, ys = (np.arange(a + patch // 2, b - patch // 2 + 1, step, float) for a, b in ((x0, x1), (y0, y1)))
    return np.array([(x, y) for y in ys for x in xs]).reshape(-1, 2)


def pairs_of(n: int, lags: tuple[int, ...]) -> list[tuple[int, int]]:
    """Snapshots so many steps apart, and each with the last."""
    return sorted({(i, j) for i in range(n) for j in (*(i + k for k in lags), n - 1) if i < j < n})


# --- patches ----------------------------------------------------------------------------------


def _spectrum(patch: np.ndarray) -> tuple[bytes, float, bool]:
    """(windowed spectrum, energy, whether every pixel is known)."""
    if not np.isfinite(patch).all():
        return b"", 0.0, False
    n, m = patch.shape
    p = (patch - patch.mean()) * np.hanning(n)[:, None] * np.hanning(m)
    return np.fft.rfft2(p).astype(np.complex64).tobytes(), float((p * p).sum()), True


def spectral_shift(fa: np.ndarray, fb: np.ndarray, n: int, upsample: int = 100) -> tuple[float, float, float]:
    """(dx, dy, height of the correlation) of two half spectra of n x n samples: the highest whole
    lag, then finer grids about it through the transform itself."""
    cross = fb * np.conj(fa)
    cc = np.fft.irfft2(cross, s=(n, n))
    y, x = (float(p - n if p > n // 2 else p) for p in np.unravel_index(int(cc.argmax()), cc.shape))
    twice = np.full(n // 2 + 1, 2.0)
    twice[0] = 1.0
    if n % 2 == 0:
        twice[-1] = 1.0
    cross, ky, kx = cross * twice, np.fft.fftfreq(n), np.arange(n // 2 + 1) / n
    height = float(cc.max())
    for width in (0.1, 1.0 / upsample):
        near = np.arange(-10, 11) * width
        fine = (np.exp(2j * np.pi * np.outer(y + near, ky)) @ cross @ np.exp(2j * np.pi * np.outer(kx, x + near))).real
        iy, ix = np.unravel_index(int(fine.argmax()), fine.shape)
        y, x, height = y + near[iy], x + near[ix], float(fine.max()) / (n * n)
    return x, y, height


def filtered(snapshots: DataFrame) -> DataFrame:
    """Snapshots (snapshot, height, width, pixels) with their walls brought out, once and for all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            walls = [wall_filter(np.frombuffer(p, np.float64).reshape(h, w)).tobytes() for h, w, p in zip(f["height"], f["width"], f["pixels"], strict=True)]
            yield f.assign(pixels=walls)

    rows = snapshots.select(F.col("snapshot").cast("long").alias("snapshot"), F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"), "pixels")
    return cut(rows.mapInPandas(run, "snapshot long, height int, width int, pixels binary"))


def patch_spectra(images: DataFrame, patch: int, centres: np.ndarray, sampling: int = 1, inverse: list[QuadMap] | None = None) -> DataFrame:
    """The spectrum of every patch of every image, read on each ``sampling``-th pixel, and through
    a map if there is one; with the structure tensor of the patch.  One transform a patch."""
    half, offsets = patch // 2, np.arange(0, patch, sampling)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            for k, h, w, p in zip(f["snapshot"], f["height"], f["width"], f["pixels"], strict=True):
                image, rows = np.frombuffer(p, np.float64).reshape(h, w), []
                for cx, cy in centres:
                    left, top = round(cx) - half, round(cy) - half
                    if inverse is None:
                        inside = left >= 0 and top >= 0 and left + patch <= w and top + patch <= h
                        part = image[top : top + patch : sampling, left : left + patch : sampling] if inside else np.full((1, 1), np.nan)
                    else:
                        x, y = np.meshgrid(left + offsets.astype(float), top + offsets.astype(float))
                        at = mapped(inverse[k], np.stack([x.ravel(), y.ravel()], 1))
                        part = bilinear(image, at[:, 0], at[:, 1]).reshape(x.shape)
                    spectrum, energy, whole = _spectrum(part)
                    gy, gx = np.gradient(part) if whole else (np.zeros(1), np.zeros(1))
                    rows.append((k, cx, cy, whole, energy, float((gx * gx).mean()), float((gy * gy).mean()), float((gx * gy).mean()), spectrum, float(part.std()) if whole else 0.0))
                out = pd.DataFrame(rows, columns=["snapshot", "x", "y", "usable", "energy", "xx", "yy", "xy", "spectrum", "texture"])
                known = out["texture"][out["texture"] > 0]
                out["usable"] &= out["texture"] > LEAST_TEXTURE * (known.median() if len(known) else 0.0)
                yield out.drop(columns="texture")

    return images.mapInPandas(run, BANK)


def registered(bank: DataFrame, pairs: list[tuple[int, int]], samples: int, spacing: int = 1) -> DataFrame:
    """The shift of every pair at every patch.  All spectra of a patch meet in one task; their
    number is that of the snapshots."""
    half = (samples, samples // 2 + 1)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f[f["usable"]].reset_index(drop=True)
        at = {k: i for i, k in enumerate(f["snapshot"])}
        spectra = [np.frombuffer(s, np.complex64).reshape(half) for s in f["spectrum"]]
        energy, tensor, out = f["energy"].to_numpy(), f[["xx", "yy", "xy"]].to_numpy(), []
        for a, b in pairs:
            if a in at and b in at:
                i, j = at[a], at[b]
                dx, dy, height = spectral_shift(spectra[i], spectra[j], samples)
                strength = math.sqrt(energy[i] * energy[j])
                out.append((a, b, f["x"][i], f["y"][i], dx * spacing, dy * spacing, height / strength if strength > 0 else 0.0, *(tensor[i] + tensor[j]) / 2))
        return pd.DataFrame(out, columns=["a", "b", "x", "y", "dx", "dy", "quality", "xx", "yy", "xy"])

    return bank.groupBy("x", "y").applyInPandas(run, SHIFTS)


# --- the chain of rough maps ------------------------------------------------------------------


def _affine(design: np.ndarray) -> np.ndarray:
    return np.vstack([design.reshape(2, 3), [0, 0, 1]])


def chained(images: DataFrame, n: int, region: tuple[int, int, int, int], patch: int, step: int) -> list[np.ndarray]:
    """3 x 3 maps of every snapshot to the last, from one affine map for each step.

    A step is one task: the shift of the whole region first, then patches about it, and a robust
    fit.  Steps that show fewer than three patches are shifts only.
    """
    x0, x1, y0, y1 = region
    centres = grid(region, patch, step)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            for k, h, w, pa, pb in zip(f["snapshot"], f["height"], f["width"], f["pa"], f["pb"], strict=True):
                earlier, later = (np.frombuffer(p, np.float64).reshape(h, w) for p in (pa, pb))
                gx, gy, _ = shift(later[y0:y1, x0:x1], earlier[y0:y1, x0:x1], 10)
                gx, gy = round(gx), round(gy)
                points, moves = [], []
                for cx, cy in centres:
                    left, top = int(cx) - patch // 2, int(cy) - patch // 2
                    if min(left + gx, top + gy) < 0 or left + gx + patch > w or top + gy + patch > h:
                        continue
                    now, then = later[top : top + patch, left : left + patch], earlier[top + gy : top + gy + patch, left + gx : left + gx + patch]
                    dx, dy, quality = shift(now, then)
                    if quality > LEAST_QUALITY:
                        points.append((cx, cy))
                        moves.append((cx + gx + dx, cy + gy + dy))
                back = np.array([1.0, 0, gx, 0, 1, gy])
                if len(points) >= 3:
                    terms = np.column_stack([np.asarray(points), np.ones(len(points))])
                    design = np.einsum("nm,ij->nijm", terms, np.eye(2)).reshape(2 * len(points), 6)
                    back, _ = robust_solve(design, np.asarray(moves).reshape(-1), 0.05)
                yield pd.DataFrame({"snapshot": [k], "back": [back.tolist()]})

    later = images.select((F.col("snapshot") - 1).alias("snapshot"), F.col("pixels").alias("pb"))
    steps = images.select("snapshot", "height", "width", F.col("pixels").alias("pa")).join(later, "snapshot")
    back = {r["snapshot"]: _affine(np.array(r["back"])) for r in steps.mapInPandas(run, "snapshot long, back array<double>").collect()}  # a row per step
    to_last = [np.eye(3)]
    for k in range(n - 2, -1, -1):
        to_last.insert(0, to_last[0] @ np.linalg.inv(back[k]))
    return to_last


def strain_axis(m: np.ndarray) -> float:
    """The direction that an affine map stretches most, in its target."""
    u, _, _ = np.linalg.svd(m[:2, :2])
    return math.atan2(u[1, 0], u[0, 0]) % math.pi


# --- the passes -------------------------------------------------------------------------------


def _weights(f: pd.DataFrame, directional: bool) -> np.ndarray:
    """(n, 2, 2): how firmly the walls of a patch hold its shift in each direction, 1 on average."""
    if not directional:
        return np.broadcast_to(np.eye(2), (len(f), 2, 2))
    t = np.empty((len(f), 2, 2))
    t[:, 0, 0], t[:, 1, 1], t[:, 0, 1] = f["xx"], f["yy"], f["xy"]
    t[:, 1, 0] = t[:, 0, 1]
    return 2 * t / np.maximum(t[:, 0, 0] + t[:, 1, 1], 1e-30)[:, None, None]


def solved(shifts: DataFrame, n: int, basis, parameters: int, directional: bool = True, floor: float = 0.02) -> tuple[np.ndarray, dict]:
    """(n, parameters): the corrections of all maps, the last one's zero, for which the shift of a
    pair is the correction of a less that of b; and what was used.

    Rows that miss by much count less from round to round, and in the end not at all.  A round is
    two aggregations: the median miss, and the blocks of the normal equations by pair.
    """

    def missed(f: pd.DataFrame, now: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        g, w = basis(f[["x", "y"]].to_numpy()), _weights(f, directional)
        d = f[["dx", "dy"]].to_numpy()
        r = np.einsum("nip,np->ni", g, now[f["a"].to_numpy(int)] - now[f["b"].to_numpy(int)]) - d
        return g, w, np.sqrt(np.maximum(np.einsum("ni,nij,nj->n", r, w, r), 0))

    def misses(now: np.ndarray) -> float:
        def run(batches):
            for f in batches:
                yield pd.DataFrame({"miss": missed(f, now)[2]})

        return shifts.mapInPandas(run, "miss double").agg(F.percentile_approx("miss", 0.5, 10_000)).first()[0]

    def blocks(now: np.ndarray, soft: float, hard: float):
        def run(batches):
            for f in batches:
                g, w, miss = missed(f, now)
                share = np.where(miss > hard, 0.0, np.minimum(1.0, soft / np.maximum(miss, 1e-12)))
                w = w * share[:, None, None]
                h = np.einsum("nip,nij,njq->npq", g, w, g).reshape(len(f), -1)
                v = np.einsum("nip,nij,nj->np", g, w, f[["dx", "dy"]].to_numpy())
                both = np.concatenate([h, v, (miss <= hard)[:, None]], 1)
                for pair, i in f.groupby(["a", "b"]).indices.items():
                    yield pd.DataFrame({"a": [pair[0]], "b": [pair[1]], "sums": [both[i].sum(0)]})

        parts = shifts.mapInPandas(run, "a long, b long, sums array<double>").select("a", "b", F.posexplode("sums").alias("at", "v"))
        return parts.groupBy("a", "b").pivot("at", list(range(parameters * (parameters + 1) + 1))).agg(F.sum("v")).collect()  # a row per pair

    now = np.zeros((n, parameters))
    used = 0
    for k in range(ROUNDS + 1):
        spread = max(1.4826 * (misses(now) or 0.0), floor) if k else math.inf
        last = k == ROUNDS
        network, pull, used = np.zeros((n, parameters, n, parameters)), np.zeros((n, parameters)), 0
        for r in blocks(now, SOFT * spread if not last else math.inf, HARD * spread if last else math.inf):
            a, b, sums = r["a"], r["b"], np.array(r[2:])
            h, v = sums[: parameters**2].reshape(parameters, parameters), sums[parameters**2 : -1]
            for i, j, sign in ((a, a, 1), (b, b, 1), (a, b, -1), (b, a, -1)):
                network[i, :, j] += sign * h
            pull[a] += v
            pull[b] -= v
            used += int(sums[-1])
        m = (n - 1) * parameters
        # Snapshots that nothing ties down keep their map.
        now[: n - 1] = np.linalg.lstsq(network[: n - 1, :, : n - 1].reshape(m, m), pull[: n - 1].reshape(-1), rcond=1e-12)[0].reshape(n - 1, parameters)
    return now, {"kept": used, "spread_px": spread}


def measure(
    snapshots: DataFrame, region: tuple[int, int, int, int] | None = None, model: str = "growth", patch: int = 384, step: int = 128, lags: tuple[int, ...] = (1, 2, 4),
    passes: int = 10, theta: float | None = None, sampling: int = 2, directional: bool = True,
) -> Growth:
    """Growth of snapshots 0 .. n - 1 (snapshot, height, width, pixels) relative to the last.

    ``region`` (x0, x1, y0, y1) is where to measure, in the last one's coordinates.
    """
    images = filtered(snapshots)
    shape = images.agg(F.max("snapshot").alias("last"), F.first("height").alias("h"), F.first("width").alias("w")).first()
    n, h, w = shape["last"] + 1, shape["h"], shape["w"]
    if n < 2:
        raise ValueError("growth needs two snapshots")
    if patch % sampling:
        raise ValueError("the patch must be a multiple of the sampling")
    center, scale = (w / 2.0, h / 2.0), max(w, h) / 2.0
    region = region or (patch // 2, w - patch // 2, patch // 2, h - patch // 2)
    centres = grid(region, patch, step)
    if len(centres) < 6:
        raise ValueError(f"only {len(centres)} patches fit into the region")
    chain = chained(images, n, region, patch, step)
    if theta is None:
        last = images.filter(F.col("snapshot") == n - 1).first()
        walls, coherence = principal_axis(np.frombuffer(bytes(last["pixels"]), np.float64).reshape(h, w))
        theta = walls if coherence >= LEAST_COHERENCE else strain_axis(chain[0])
    sample = grid(region, 2, 64)
    flat = np.column_stack([sample, np.ones(len(sample))])
    sources = [(flat @ np.linalg.inv(m).T)[:, :2] for m in chain]
    forward = [fitted_map(s, sample, center, scale) for s in sources]
    inverse = [fitted_map(sample, s, center, scale) for s in sources]
    out = Growth(forward, inverse, theta, steps=[list(forward)])

    def basis(points: np.ndarray) -> np.ndarray:
        return displacement_basis(points, model, theta, center, scale)

    parameters, pairs = basis(centres[:1]).shape[2], pairs_of(n, lags)
    for k in range(passes):
        bank = patch_spectra(images, patch, centres, sampling, inverse)
        shifts = cut(registered(bank, pairs, patch // sampling, sampling).filter(F.col("quality") > LEAST_QUALITY))
        correction, used = solved(shifts, n, basis, parameters, directional)
        moved = [basis(sample) @ c for c in correction]
        # What is left of a map is a displacement in the last geometry: p -> map(p) + left(map(p)).
        sources = [mapped(inverse[i], sample) for i in range(n)]
        forward = [fitted_map(s, sample + e, center, scale) for s, e in zip(sources, moved, strict=True)]
        inverse = [fitted_map(sample + e, s, center, scale) for s, e in zip(sources, moved, strict=True)]
        rms = math.sqrt(np.mean([(basis(centres) @ c) ** 2 for c in correction[: n - 1]]) * 2)
        out.history.append({"pass": k + 1, "rms_px": rms} | used)
        out.steps.append(list(forward))
        if rms < CONVERGED or k and rms > STALLED * out.history[-2]["rms_px"]:
            break
    out.forward, out.inverse = forward, inverse
    return out


# --- records ----------------------------------------------------------------------------------


def _numbers(m: QuadMap) -> dict:
    return {"coef": [list(c) for c in m.coef], "center": list(m.center), "scale": m.scale}


def _map(d: dict) -> QuadMap:
    return QuadMap([tuple(c) for c in d["coef"]], tuple(d["center"]), d["scale"])


def save_growth(path: str, times: list[float], growth: Growth) -> None:
    """A measured growth with its times, and beside it the maps of every stage."""
    with open(path, "w") as f:
        json.dump({"kind": "growth", "t_epoch": times, "theta": growth.theta, "forward": list(map(_numbers, growth.forward)), "inverse": list(map(_numbers, growth.inverse)), "history": growth.history}, f)
    with open(f"{path}.steps", "w") as f:
        json.dump([list(map(_numbers, maps)) for maps in growth.steps], f)


def load_growth(path: str) -> tuple[list[float], Growth]:
    """The record; without the stages if what was kept of them is gone or damaged."""
    with open(path) as f:
        d = json.load(f)
    if d.get("kind") != "growth" or "inverse" not in d:
        raise ValueError(f"{path} is not a measured growth")
    try:
        with open(f"{path}.steps") as f:
            steps = [list(map(_map, maps)) for maps in json.load(f)]
    except (OSError, ValueError, KeyError, TypeError):
        steps = []
    return d["t_epoch"], Growth(list(map(_map, d["forward"])), list(map(_map, d["inverse"])), d["theta"], d["history"], steps)
