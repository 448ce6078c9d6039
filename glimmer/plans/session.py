"""Sessions: a JSON plan of sources, settings and stages that is built again into DataFrames."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

VERSION = 1
#: Stage name to function (spark, inputs so far, settings) -> DataFrame.
STAGES: dict[str, Callable[[SparkSession, dict[str, DataFrame], dict], DataFrame]] = {}


def stage(name: str):
    def register(fn):
        STAGES[name] = fn
        return fn

    return register


def write_session(path: str, sources: dict[str, str], settings: dict, rebuild: list[str], expected: dict[str, int]) -> None:
    base = os.path.dirname(os.path.abspath(path))
    recorded = {k: {"relative": os.path.relpath(v, base), "absolute": os.path.abspath(v)} for k, v in sources.items()}
    with open(path, "w") as f:
        json.dump({"session": VERSION, "sources": recorded, "settings": settings, "rebuild": rebuild, "expected": expected}, f, default=str)


def read_session(path: str) -> dict:
    with open(path) as f:
        out = json.load(f)
    if "session" not in out:
        raise ValueError("not a session file")
    if out["session"] > VERSION:
        raise ValueError(f"a session of version {out['session']} is newer than {VERSION}")
    return out


def source_path(path: str, recorded: dict[str, str]) -> str | None:
    """Where a source is now: next to the session first, else where it was."""
    near = os.path.normpath(os.path.join(os.path.dirname(os.path.abspath(path)), recorded["relative"]))
    return next((p for p in (near, recorded["absolute"]) if os.path.exists(p)), None)


def build(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], list[str]]:
    """Run the stages of a session again; also the counts that differ from what it expected."""
    s = read_session(path)
    made: dict[str, DataFrame] = {}
    for name, recorded in s["sources"].items():
        where = source_path(path, recorded)
        if where is None:
            raise FileNotFoundError(recorded["absolute"])
        made[name] = spark.read.parquet(where)
    for name in s["rebuild"]:
        made[name] = STAGES[name](spark, made, s["settings"].get(name, {}))
    wrong = [f"{k}: {n} expected, {got} found" for k, n in s["expected"].items() if k in made and (got := made[k].count()) != n]
    return made, wrong


@stage("filtered")
def _filtered(spark: SparkSession, made: dict[str, DataFrame], settings: dict) -> DataFrame:
    from glimmer.operators.filters import range_filter

    return range_filter(made["localizations"], {k: tuple(v) for k, v in settings.get("bounds", {}).items()})


@stage("trajectories")
def _trajectories(spark: SparkSession, made: dict[str, DataFrame], settings: dict) -> DataFrame:
    from glimmer.operators.link import link

    return link(made.get("filtered", made["localizations"]), settings["search"], settings.get("memory", 0), settings.get("least", 1))
