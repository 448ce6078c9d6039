"""Linking of localizations into trajectories by nearest positions in later frames.

Candidate links come from a grid-cell equi-join.  Candidates that share a point form a
subnet; a subnet of one link is final, the others are solved for the least sum of squared
displacements, a point without a link costing the search range squared.

With a memory, a point may wait for that many frames, so what a frame can link depends on what
the frames before it have linked.  That order is not run through one by one: all frames are
solved at once as if there were no memory, and then again wherever the links of the round before
open or close a candidate, until none does.  The first frame is right after one round, and a
frame one round after those that it depends on, so the links that stay are those of the
frame-by-frame order.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from glimmer.session import cut

#: Groups of frames, for each shuffle partition, whose contested subnets are solved in one call.
SHARES = 4
#: Frames of a round that are sent to all tasks; more are dealt out.
FEW = 10_000


def _met(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """The join of two tables that grow with the points, dealt out by key.  Left to itself, Spark sends a
    table of up to some 10 MB through the driver, in this and in every round, whose copies add up there."""
    return left.join(right.hint("merge"), on, how)


def _spread(points: DataFrame, search: float, reach: int) -> DataFrame:
    """``points`` with a copy for each cell (block, cx, cy) that holds what they can link to: cells
    are twice the range wide and ``reach`` frames long, so a point has four copies in a plane, or a
    few more at an edge (rounding never loses a pair), in at most two blocks."""
    block = lambda k: F.floor((F.col("frame") + k) / reach)
    out = points.withColumn("block", F.explode(F.sequence(block(1), block(reach))))
    for c, v in (("cx", "x"), ("cy", "y")):
        at = F.col(v) / (2 * search)
        out = out.withColumn(c, F.explode(F.sequence(F.floor(at - 0.5001), F.floor(at + 0.5001))))
    return out


def candidates(points: DataFrame, search: float, by: tuple[str, ...] = (), memory: int = 0) -> DataFrame:
    """(by, frame, a, b, gap, sq): pairs of points (by their ``loc``) within the range, b in one of
    the ``memory + 1`` frames after that of a (``frame`` is that of b)."""
    reach = memory + 1
    p = points.select(*by, "loc", F.col("frame").cast("long").alias("frame"), "x", "y")
    a = _spread(p, search, reach).select(*by, F.col("loc").alias("a"), F.col("frame").alias("fa"), F.col("x").alias("xa"), F.col("y").alias("ya"), "block", "cx", "cy")
    cell = [F.floor(F.col("frame") / reach).alias("block"), *[F.floor(F.col(v) / (2 * search)).alias(c) for c, v in (("cx", "x"), ("cy", "y"))]]
    b = p.select(*by, F.col("loc").alias("b"), "frame", F.col("x").alias("xb"), F.col("y").alias("yb"), *cell)
    gap = F.col("frame") - F.col("fa")
    sq = F.pow(F.col("xa") - F.col("xb"), 2) + F.pow(F.col("ya") - F.col("yb"), 2)
    met = _met(a, b, [*by, "block", "cx", "cy"]).withColumn("gap", gap).withColumn("sq", sq)
    return met.filter(F.col("gap").between(1, reach) & (F.col("sq") <= search * search)).select(*by, "frame", "a", "b", "gap", "sq")


def _subnets(cost: dict[tuple[int, int], float]) -> list[list[tuple[int, int]]]:
    """The candidates of each connected set of points, in order."""
    of: dict[tuple[str, int], tuple[str, int]] = {}

    def top(p):
        while of.setdefault(p, p) != p:
            of[p] = p = of[of[p]]
        return p

    for a, b in cost:
        i, j = top(("a", a)), top(("b", b))
        if i != j:
            of[max(i, j)] = min(i, j)
    nets: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for a, b in sorted(cost):
        nets.setdefault(top(("a", a)), []).append((a, b))
    return list(nets.values())


def _cheapest(gain: np.ndarray) -> np.ndarray:
    """For each row its column, so that the sum of the entries is least: shortest augmenting paths,
    one row after the other.  There are at least as many columns as rows."""
    n, m = gain.shape
    price, level = np.zeros(m + 1), np.zeros(n)
    row_of = np.full(m + 1, -1)  # the last column is where a new row starts
    for i in range(n):
        row_of[m], j = i, m
        best, before, done = np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, bool)
        while row_of[j] >= 0:
            done[j] = True
            reached = gain[row_of[j]] - level[row_of[j]] - price[:m]
            better = ~done[:m] & (reached < best)
            best[better], before[better] = reached[better], j
            free = np.where(done[:m], np.inf, best)
            to = int(free.argmin())
            step = free[to]
            level[row_of[done]] += step
            price[done] -= step
            best[~done[:m]] -= step
            j = to
        while j != m:
            row_of[j], j = row_of[before[j]], before[j]
    out = np.empty(n, np.int64)
    for j in range(m):
        if row_of[j] >= 0:
            out[row_of[j]] = j
    return out


def assign(cost: dict[tuple[int, int], float], lost: float) -> list[tuple[int, int]]:
    """Links of least total cost among candidates, an unlinked source costing ``lost``.

    Each connected subnet is solved exactly, in time of the third power of its points.
    """
    out = []
    for net in _subnets(cost):
        if len({a for a, _ in net}) == 1 or len({b for _, b in net}) == 1:
            out.append(min(net, key=lambda e: (cost[e], e)))
            continue
        sources, targets = (sorted({e[k] for e in net}) for k in (0, 1))
        at = {a: i for i, a in enumerate(sources)}, {b: j for j, b in enumerate(targets)}
        # A source has a column of its own for being lost; what cannot be linked costs more than all that can.
        table = np.full((len(sources), len(targets) + len(sources)), (lost + 1) * (len(sources) + 1))
        table[np.arange(len(sources)), len(targets) + np.arange(len(sources))] = lost
        for a, b in net:
            table[at[0][a], at[1][b]] = cost[a, b]
        out += [(a, targets[j]) for a, j in zip(sources, _cheapest(table), strict=True) if j < len(targets)]
    return out


def _solved(edges: DataFrame, search: float, by: tuple[str, ...]) -> DataFrame:
    """(by, frame, a, b): the links of each frame among candidates (by, frame, a, b, sq).

    What nothing competes for in its frame stays in the JVM.  The rest is dealt by frame into
    ``SHARES`` groups for each shuffle partition, and a group's subnets are solved one by one.
    """
    names = [*by, "frame", "a", "b"]
    count = lambda *key: F.count(F.lit(1)).over(Window.partitionBy(*key))
    counted = edges.withColumn("na", count(*by, "frame", "a")).withColumn("nb", count(*by, "frame", "b"))
    schema = StructType([edges.schema[c] for c in names])

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        cost = {((frame, a), b): sq for frame, a, b, sq in zip(f["frame"].tolist(), f["a"].tolist(), f["b"].tolist(), f["sq"].tolist(), strict=True)}
        found = pd.DataFrame([(*a, b) for a, b in assign(cost, search * search)], columns=["frame", "a", "b"]).astype(f.dtypes[["frame", "a", "b"]])
        return found.merge(f, on=["frame", "a", "b"])[names]

    contested = counted.filter("na > 1 OR nb > 1").select(*names, "sq")
    groups = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")) * SHARES
    by_python = contested.groupBy(F.pmod(F.xxhash64(*by, "frame"), F.lit(groups)).alias("_some")).applyInPandas(solve, schema)
    return counted.filter("na = 1 AND nb = 1").select(names).unionByName(by_python)


def links(points: DataFrame, search: float, memory: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """(a, b): each point and the next one of its trajectory."""
    edges = candidates(points, search, by, memory)
    if not memory:
        return _solved(edges, search, by).select("a", "b")
    edges = cut(edges)
    found, before = cut(_solved(edges.filter("gap = 1"), search, by)), None
    while True:
        now = cut(found.groupBy("a").agg(F.min("frame").alias("is")))
        state = _met(edges, now if before is None else _met(now, before, "a", "full"), "a", "left")
        is_open = F.col("is").isNull() | (F.col("is") >= F.col("frame"))  # not linked to a frame before
        was_open = F.col("gap") == 1 if before is None else F.col("was").isNull() | (F.col("was") >= F.col("frame"))
        frames = cut(state.filter(is_open != was_open).select(*by, "frame").distinct())
        n = frames.count()
        if not n:
            return found.select("a", "b")
        frames = frames.hint("broadcast" if n <= FEW else "merge")
        again = state.filter(is_open).join(frames, [*by, "frame"], "left_semi").select(edges.columns)
        found = cut(found.join(frames, [*by, "frame"], "left_anti").unionByName(_solved(again, search, by)))
        before = now.withColumnRenamed("is", "was")


def link(points: DataFrame, search: float, memory: int = 0, least: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """``points`` (loc LONG unique, frame, x, y) with ``particle``: the ``loc`` of the first point of
    its trajectory; trajectories of fewer than ``least`` points are left out."""
    roots = cut(links(points, search, memory, by).select(F.col("b").alias("loc"), F.col("a").alias("root")))
    while True:  # pointer doubling: the number of rounds is the logarithm of the longest trajectory
        step = roots.select(F.col("loc").alias("root"), F.col("root").alias("next"))
        new = cut(_met(roots, step, "root", "left").select("loc", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        roots = new.drop("moved")
        if new.filter("moved").isEmpty():
            break
    linked = _met(points, roots, "loc", "left").withColumn("particle", F.coalesce("root", "loc")).drop("root")
    if least > 1:
        long = linked.groupBy("particle").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select("particle")
        linked = _met(linked, long, "particle", "left_semi")
    return linked


def link_frames(frames: list[int], locs: list[int], xy: np.ndarray, search: float, memory: int, live: dict[int, tuple[int, np.ndarray]] | None = None) -> dict[int, int]:
    """Particle of each point of one acquisition, given in frame order.

    ``live`` (particle to last frame and position) is where to go on from, and is updated.
    """
    live = {} if live is None else live
    out: dict[int, int] = {}
    start = 0
    while start < len(frames):
        f = frames[start]
        end = start
        while end < len(frames) and frames[end] == f:
            end += 1
        for p in [p for p, v in live.items() if f - v[0] > memory + 1]:
            del live[p]
        cells: dict[tuple[int, int], list[int]] = {}
        for p, (_, at) in live.items():
            cells.setdefault((int(at[0] // search), int(at[1] // search)), []).append(p)
        cost = {}
        for i in range(start, end):
            cx, cy = int(xy[i, 0] // search), int(xy[i, 1] // search)
            for p in (q for dx, dy in product((-1, 0, 1), repeat=2) for q in cells.get((cx + dx, cy + dy), ())):
                sq = float(((xy[i] - live[p][1]) ** 2).sum())
                if sq <= search * search:
                    cost[p, i] = sq
        of = {i: p for p, i in assign(cost, search * search)}
        for i in range(start, end):
            p = of.get(i, locs[i])
            out[locs[i]] = p
            live[p] = (f, xy[i])
        start = end
    return out
