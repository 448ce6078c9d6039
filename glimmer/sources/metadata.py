"""Acquisition metadata of all stacks of a folder, as one table.

Files are met by name with equi-joins over their listing: the sidecar of a stack (that of the
first part for a stack in several), and the acquisition JSON with the longest prefix.  Of each
file only a head of ``HEAD`` bytes is read, of a stack only its directories and the summary at its
front.  A head mostly ends inside a record; records that are cut off are left out.  What the
sources say of a field is ranked by trust, and the aggregation keeps the best with its source.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.sources.stack import directories, opened
from glimmer.sources.tables import elapsed_times, json_object, measured_interval, number, positive

#: Bytes of a sidecar that are read, and characters of an OME header that are searched.
HEAD, OME_HEAD = 4 << 20, 1 << 16

# Nanometres and milliseconds in the units of OME.
_NM = {"nm": 1.0, "um": 1e3, "µm": 1e3, "μm": 1e3, "mm": 1e6, "cm": 1e7, "m": 1e9}
_MS = {"ms": 1.0, "s": 1e3, "us": 1e-3, "µs": 1e-3, "μs": 1e-3, "ns": 1e-6, "min": 6e4}
# Fixed value: what stands before the length of the summary in the stacks of Micro-Manager.
_SUMMARY_MARK = 2355492

FOUND = "stack string, field string, rank int, number double, text string, source string"


class Findings:
    """Values of a source, in order of trust."""

    def __init__(self, where: str) -> None:
        self.where, self.rows = where, []

    def add(self, field: str, value: float | None, what: str, zero: bool = False) -> None:
        value = number(value) if zero else positive(value)
        if value is not None and value >= 0 and not isinstance(value, bool):
            self.rows.append((field, value, None, f"{self.where}: {what}"))

    def note(self, field: str, value: object, what: str) -> None:
        if value is not None and str(value).strip():
            self.rows.append((field, None, str(value).strip(), f"{self.where}: {what}"))


def _object(text: str, opening: str) -> dict:
    """The JSON object whose brace ends the first match; nothing if it is cut off or damaged."""
    m = re.search(opening, text)
    found = json_object(text, m.end() - 1) if m else None
    return json.loads(found) if found else {}


def _plain(record: dict, key: str) -> object:
    value = record.get(key)
    return value.get("scalar") if isinstance(value, dict) else value


def _of_camera(sources: list[dict], name: str, camera: object) -> object:
    """A property of the camera by its own name, else of any device that is called a camera."""
    for source in sources:
        keys = [f"{camera}-{name}", f"Camera-{name}", *(k for k in source if k.endswith(f"-{name}") and k.lower().startswith("camera"))]
        for key in keys:
            if (value := _plain(source, key)) not in (None, ""):
                return value
    return None


def sidecar_findings(name: str, text: str) -> list[tuple]:
    """Measured timing, then the state of the devices, of a Micro-Manager sidecar."""
    out = Findings(name)
    times = elapsed_times(text)
    out.add("frame_interval_ms", measured_interval(times), f"measured over {len(times)} frames of ElapsedTime-ms")
    record, summary = _object(text, r'"FrameKey-\d+-\d+-\d+"\s*:\s*\{'), _object(text, r'"Summary"\s*:\s*\{')
    scope = summary.get("InitialScopeData")
    devices = [record, scope if isinstance(scope, dict) else {}]
    camera = next((c for d in devices if (c := _plain(d, "Core-Camera"))), None)
    out.add("frame_interval_ms", summary.get("Interval_ms"), "Summary.Interval_ms")
    out.add("frame_interval_ms", _of_camera(devices, "ActualInterval-ms", camera), "ActualInterval-ms")
    for holder, key, what in ((record, "PixelSizeUm", "FrameKey.PixelSizeUm"), (summary, "PixelSize_um", "Summary.PixelSize_um")):
        size = positive(holder.get(key))
        out.add("pixel_size_nm", size and size * 1000, what)
    out.add("exposure_ms", record.get("Exposure-ms"), "Exposure-ms")
    out.add("exposure_ms", _of_camera(devices, "Exposure", camera), "camera Exposure")
    out.add("camera_offset_adu", _of_camera(devices, "Offset", camera), "camera Offset", zero=True)
    for field, key in (("n_frames", "Frames"), ("width", "Width"), ("height", "Height")):
        out.add(field, summary.get(key), f"Summary.{key}")
    out.add("bit_depth", record.get("BitDepth"), "BitDepth")
    out.note("start_time", summary.get("StartTime"), "Summary.StartTime")
    out.note("roi", record.get("ROI"), "ROI")
    out.note("camera_chip", _of_camera(devices, "ChipName", camera), "ChipName")
    nose = next((k for k in record if k.endswith(("NosePiece-Label", "Objective-Label"))), None)
    out.note("objective", nose and _plain(record, nose), str(nose))
    return out.rows


def acquisition_findings(name: str, text: str) -> list[tuple]:
    """The calibration that the acquisition program wrote beside its stacks."""
    # The names of its fields.
    out = Findings(name)
    try:
        data = json.loads(text)
    except ValueError:
        return []
    part = lambda d, key: v if isinstance(d, dict) and isinstance(v := d.get(key), dict) else {}
    config = part(data, "config")
    out.note("wl_orientation", part(config, "focus_lock").get("wl_orientation"), "focus_lock.wl_orientation")
    out.add("pixel_size_nm", part(config, "pixel_calibration").get("kuro_nm_per_px"), "pixel_calibration.kuro_nm_per_px")
    roi = part(part(config, "acquisition_options"), "camera_sensor_roi")
    for key in ("x", "y"):
        out.add(f"sensor_roi_{key}", roi.get(key), f"camera_sensor_roi.{key}", zero=True)
    return out.rows


def ome_findings(name: str, text: str) -> list[tuple]:
    out = Findings(name)
    m = re.search(r"<(?:\w+:)?Pixels\b([^>]*)>", text[:OME_HEAD])
    tags = dict(re.findall(r'([\w:]+)\s*=\s*"([^"]*)"', m[1])) if m else {}
    for field, key, units, unit in (("pixel_size_nm", "PhysicalSizeX", _NM, "µm"), ("frame_interval_ms", "TimeIncrement", _MS, "s")):
        value, factor = positive(tags.get(key)), units.get(tags.get(f"{key}Unit", unit))
        out.add(field, value and factor and value * factor, f"OME {key}")
    for field, key in (("n_frames", "SizeT"), ("width", "SizeX"), ("height", "SizeY")):
        out.add(field, tags.get(key), f"OME {key}")
    return out.rows


def stack_findings(name: str, f, size: int) -> list[tuple]:
    """The summary and the OME block inside a stack; what cannot be read says nothing."""
    rows: list[tuple] = []
    try:
        head = f.read_at(min(size, 40), 0)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        if order and len(head) == 40 and struct.unpack(order + "I", head[32:36])[0] == _SUMMARY_MARK:
            n = struct.unpack(order + "I", head[36:40])[0]
            summary = json.loads(f.read_at(min(n, HEAD), 40).split(b"\0")[0].decode("utf-8", "replace"))
            out = Findings(name)
            out.add("frame_interval_ms", summary.get("Interval_ms"), "MM Summary.Interval_ms")
            pixel = positive(summary.get("PixelSize_um"))
            out.add("pixel_size_nm", pixel and pixel * 1000, "MM Summary.PixelSize_um")
            out.add("n_frames", summary.get("Frames"), "MM Summary.Frames")
            rows += out.rows
    except (ValueError, AttributeError):
        pass
    try:
        tags = next(directories(f, size), {})
        said = tags.get(270, (b"",))[0].split(b"\0")[0].decode("utf-8", "replace")
        rows += ome_findings(name, said) if "<" in said[:200] else []
    except ValueError:
        pass
    return rows


def companions(files: DataFrame) -> DataFrame:
    """(stack, path, length, kind, trust) of the files that tell of each stack: its acquisition
    JSON, its sidecar, itself."""
    named = files.withColumn("folder", F.regexp_replace("path", "[^/]*$", "")).withColumn("name", F.element_at(F.split("path", "/"), -1))
    base = F.regexp_replace(F.regexp_replace("name", r"(?i)\.tiff?$", ""), r"(?i)\.ome$", "")
    stacks = named.filter(F.col("name").rlike(r"(?i)\.tiff?$")).select(F.col("path").alias("stack"), "length", "folder", "name", base.alias("base"))
    # A part of a long acquisition is described by the sidecar of the first part.
    bases = F.array_distinct(F.array("base", F.regexp_replace("base", r"_\d+$", "")))
    wanted = stacks.select("stack", "folder", F.posexplode(bases).alias("order", "b")).withColumn("name", F.concat("b", F.lit("_metadata.txt")))
    pieces = F.split("name", "_")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda k: F.array_join(F.slice(pieces, 1, k), "_"))
    begun = stacks.filter(F.size(pieces) > 1).select("stack", "folder", F.explode(prefixes).alias("b"))
    begun = begun.select("stack", "folder", (-F.char_length("b")).alias("order"), F.concat("b", F.lit("_metadata.json")).alias("name"))
    text = named.select("folder", "name", "path", "length")
    out = stacks.select("stack", F.col("stack").alias("path"), "length", F.lit("stack").alias("kind"), F.lit(2).alias("trust"))
    for kind, asked, trust in (("acquisition", begun, 0), ("sidecar", wanted.drop("b"), 1)):
        best = asked.join(text, ["folder", "name"]).groupBy("stack").agg(F.min_by(F.struct("path", "length"), "order").alias("f"))
        out = out.unionByName(best.select("stack", "f.path", "f.length", F.lit(kind).alias("kind"), F.lit(trust).alias("trust")))
    return out


def acquisition_metadata(spark: SparkSession, folder: str, head: int = HEAD) -> DataFrame:
    """(stack, field, number, text, source): every recorded field of every stack under a folder,
    from the source most to be trusted.  Measured timing beats what was asked for, which beats what
    the camera reports; ``fps`` follows from the interval.  A field that nothing recorded is absent."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    told = companions(files)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for stack, path, size, kind, trust in batch[["stack", "path", "length", "kind", "trust"]].itertuples(index=False):
                name = path.rsplit("/", 1)[-1]
                with opened(path) as f:
                    if kind == "stack":
                        found = stack_findings(name, f, size)
                    else:
                        text = f.read_at(min(size, head), 0).decode("utf-8-sig", "replace")
                        found = (sidecar_findings if kind == "sidecar" else acquisition_findings)(name, text)
                rows += [(stack, field, 1000 * trust + k, value, words, source) for k, (field, value, words, source) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["stack", "field", "rank", "number", "text", "source"])

    tasks = max(1, min(told.count(), 10_000))
    found = told.repartition(tasks, "stack", "kind").mapInPandas(run, FOUND)
    best = found.groupBy("stack", "field").agg(F.min_by(F.struct("number", "text", "source"), "rank").alias("v")).select("stack", "field", "v.*")
    both = F.when(F.col("field") == "frame_interval_ms", F.array(F.struct("field", "number"), F.struct(F.lit("fps").alias("field"), (1000 / F.col("number")).alias("number"))))
    return best.select("stack", F.inline(F.coalesce(both, F.array(F.struct("field", "number")))), "text", "source").select("stack", "field", "number", "text", "source")
