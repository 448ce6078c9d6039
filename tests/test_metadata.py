"""Metadata and snapshots from files made here."""

import json
import struct

import numpy as np
import pytest
from test_stack import tiff

from glimmer.sources import metadata as M
from glimmer.sources import snapshots as W

ONE = np.arange(12, dtype=np.uint16).reshape(1, 3, 4)


def sidecar(n=20, step=31.47, summary=None, record=None) -> str:
    s = {"Frames": 500, "Width": 64, "Height": 48, "Interval_ms": 0.0, "PixelSize_um": 0.16, "StartTime": "2026-01-02", "MDA": '{"a": "}{"}', "InitialScopeData": {"Core-Camera": {"scalar": "Cam-1"}, "Cam-1-Offset": "95"}} | (summary or {})
    r = {"Exposure-ms": 30.0, "BitDepth": 16, "ROI": "0-0-64-48", "PixelSizeUm": 0.0, "Nikon-NosePiece-Label": "100x"} | (record or {})
    records = [f'"FrameKey-{k}-0-0": {json.dumps(r | {"ElapsedTime-ms": round(step * k)})}' for k in range(n)]
    return f'{{"Summary": {json.dumps(s)}, ' + ", ".join(records)


def of(spark, folder, **kw) -> dict:
    out = {}
    for r in M.acquisition_metadata(spark, str(folder), **kw).collect():
        out.setdefault(r.stack.rsplit("/", 1)[-1], {})[r.field] = (r.number if r.text is None else r.text, r.source)
    return out


def test_a_folder_of_acquisitions(spark, tmp_path):
    run = tmp_path / "run"
    run.mkdir()
    for name in ("a_Pos0.ome.tif", "a_Pos0_1.ome.tif", "a_Pos0_x_normal.tif", "lonely.TIF"):
        (run / name).write_bytes(tiff(ONE))
    (run / "a_Pos0_metadata.txt").write_text(sidecar() + ', "FrameKey-20-0-0": {"Exp')  # cut off
    (run / "a_metadata.json").write_text(json.dumps({"config": {"pixel_calibration": {"kuro_nm_per_px": 111}}}))
    (run / "a_Pos0_x_metadata.json").write_text(json.dumps({"config": {"pixel_calibration": {"kuro_nm_per_px": 81.5}, "focus_lock": {"wl_orientation": "rot90"}, "acquisition_options": {"camera_sensor_roi": {"x": 0, "y": 12, "w": None}}}}))
    got = of(spark, tmp_path)
    assert set(got) == {"a_Pos0.ome.tif", "a_Pos0_1.ome.tif", "a_Pos0_x_normal.tif"}  # nothing is recorded of the lonely one
    first = got["a_Pos0.ome.tif"]
    assert first == got["a_Pos0_1.ome.tif"]
    assert first["frame_interval_ms"][0] == pytest.approx(31.47, abs=0.06) and "measured over 20 frames" in first["frame_interval_ms"][1]
    assert first["fps"][0] == pytest.approx(1000 / first["frame_interval_ms"][0])
    assert first["pixel_size_nm"] == (111.0, "a_metadata.json: pixel_calibration.kuro_nm_per_px")
    assert first["camera_offset_adu"][0] == 95 and first["exposure_ms"][0] == 30 and first["objective"][0] == "100x" and first["n_frames"][0] == 500
    part = got["a_Pos0_x_normal.tif"]
    assert {k: v[0] for k, v in part.items()} == {"pixel_size_nm": 81.5, "wl_orientation": "rot90", "sensor_roi_x": 0.0, "sensor_roi_y": 12.0}


def test_trust(spark, tmp_path):
    (tmp_path / "s.tif").write_bytes(tiff(ONE))
    text = sidecar(3, summary={"Interval_ms": 40.0}, record={"Cam-1-ActualInterval-ms": {"scalar": "33"}, "Core-Camera": "Cam-1"})
    (tmp_path / "s_metadata.txt").write_text(text)
    assert of(spark, tmp_path)["s.tif"]["frame_interval_ms"][0] == 40.0  # too few frames to measure
    (tmp_path / "s_metadata.txt").write_text(text.replace('"Interval_ms": 40.0', '"Interval_ms": 0.0'))
    assert of(spark, tmp_path)["s.tif"]["frame_interval_ms"][0] == 33.0


def test_only_the_head_is_read(spark, tmp_path):
    (tmp_path / "s.tif").write_bytes(tiff(ONE))
    (tmp_path / "s_metadata.txt").write_text(sidecar(400))
    got = of(spark, tmp_path, head=6000)["s.tif"]
    n = int(got["frame_interval_ms"][1].split("over ")[1].split()[0])
    assert 8 <= n < 400 and got["width"][0] == 64


def test_inside_the_stack(spark, tmp_path):
    ome = '<?xml version="1.0"?><OME><Image><Pixels SizeT="7" SizeX="4" SizeY="3" PhysicalSizeX="0.1" PhysicalSizeXUnit="µm" TimeIncrement="25" TimeIncrementUnit="ms"/></Image></OME>\0'.encode()
    (tmp_path / "o.ome.tif").write_bytes(tiff(ONE, description=ome))
    (tmp_path / "b.tif").write_bytes(tiff(ONE, big=True, description=ome.replace(b"0.1", b"0.2").replace("µm".encode(), b"lightyears")))
    body = tiff(ONE)
    summary = json.dumps({"Interval_ms": 12.5, "PixelSize_um": 0.3, "Frames": 9}).encode()
    directory = struct.unpack("<I", body[4:8])[0]
    moved = 40 + len(summary)
    fixed = bytearray(body[8:])
    n = struct.unpack_from("<H", fixed, directory - 8)[0]
    for k in range(n):  # places that the directory names move with the body
        at = directory - 8 + 2 + 12 * k
        if struct.unpack_from("<H", fixed, at)[0] == 273:
            struct.pack_into("<I", fixed, at + 8, struct.unpack_from("<I", fixed, at + 8)[0] + moved - 8)
    (tmp_path / "m.tif").write_bytes(b"II*\0" + struct.pack("<I", directory + moved - 8) + b"\0" * 24 + struct.pack("<II", 2355492, len(summary)) + summary + bytes(fixed))
    (tmp_path / "broken.tif").write_bytes(b"II*\0" + b"\xff" * 60)
    got = {k: {f: v[0] for f, v in d.items()} for k, d in of(spark, tmp_path).items()}
    assert got == {
        "o.ome.tif": {"pixel_size_nm": 100.0, "frame_interval_ms": 25.0, "fps": 40.0, "n_frames": 7.0, "width": 4.0, "height": 3.0},
        "b.tif": {"frame_interval_ms": 25.0, "fps": 40.0, "n_frames": 7.0, "width": 4.0, "height": 3.0},
        "m.tif": {"frame_interval_ms": 12.5, "fps": 80.0, "pixel_size_nm": 300.0, "n_frames": 9.0},
    }


def test_damaged_files_say_nothing(spark, tmp_path):
    (tmp_path / "s_1_x.tif").write_bytes(tiff(ONE))
    (tmp_path / "s_1_x_metadata.txt").write_bytes(b"\xff\xfe{{{")
    (tmp_path / "s_1_metadata.json").write_text('{"config": [1, 2')
    assert of(spark, tmp_path) == {}
    (tmp_path / "s_1_metadata.json").write_text('{"config": {"pixel_calibration": {"kuro_nm_per_px": true}, "focus_lock": 3}}')
    assert of(spark, tmp_path) == {}


# --- snapshots --------------------------------------------------------------------------------


@pytest.fixture()
def series(tmp_path):
    """Six snapshots of a texture that drifts, in a stack that goes on in a second file."""
    rng = np.random.default_rng(0)
    f = np.fft.fftfreq(128)
    texture = np.fft.ifft2(np.fft.fft2(rng.normal(0, 1, (128, 128))) * np.exp(-60 * (f[:, None] ** 2 + f**2))).real
    texture = (texture / texture.std() * 500 + 3000).astype(np.uint16)
    drift = [(0, 0), (3, -1), (5, -2), (8, -4), (12, -5), (15, -7)]
    movie = np.stack([np.roll(texture, (dy, dx), (0, 1)) for dx, dy in drift])
    (tmp_path / "a_WL_images.tif").write_bytes(tiff(movie[:4], compression=8))
    (tmp_path / "a_WL_images_001.tif").write_bytes(tiff(movie[4:], compression=8))
    lines = ["t_epoch,file,page", *(f"{100 + 10 * k},a_WL_images{'_001' if k > 3 else ''}.tif,{k % 4}" for k in range(6)), "170,a_WL_images_002.tif,0"]
    (tmp_path / "a_WL_times.csv").write_text("\n".join(lines) + "\n")
    return tmp_path, movie, drift


def test_snapshots_that_are_there(spark, series):
    folder, movie, _ = series
    index = W.snapshot_index(spark, f"{folder}/a_WL_images.tif", f"{folder}/a_WL_times.csv")
    assert sorted((r.snapshot, r.t) for r in index.collect()) == [(k, 100.0 + 10 * k) for k in range(6)]  # not the seventh
    got = {r.snapshot: np.frombuffer(bytes(r.pixels)).reshape(128, 128) for r in W.snapshots(index.filter("snapshot IN (1, 5)")).collect()}
    assert sorted(got) == [1, 5] and all(np.array_equal(got[k], movie[k]) for k in got)
    (folder / "a_WL_images_001.tif").unlink()
    assert W.snapshot_index(spark, f"{folder}/a_WL_images.tif", f"{folder}/a_WL_times.csv").count() == 4


def test_times_without_files_and_pages(spark, series):
    folder, movie, _ = series
    (folder / "a_WL_times.csv").write_text("t_epoch\n" + "".join(f"{k}\n" for k in range(6)))
    index = W.snapshot_index(spark, f"{folder}/a_WL_images.tif", f"{folder}/a_WL_times.csv")
    assert sorted((r.snapshot, r.page, r.t) for r in index.collect()) == [(k, k, float(k)) for k in range(4)]
    (folder / "a_WL_times.csv").write_text("time\n1\n")
    with pytest.raises(ValueError, match="t_epoch"):
        W.snapshot_index(spark, f"{folder}/a_WL_images.tif", f"{folder}/a_WL_times.csv")
    (folder / "a_WL_times.csv").write_text("t_epoch,file\n1,gone.tif\n")
    with pytest.raises(ValueError, match="none of the files"):
        W.snapshot_index(spark, f"{folder}/a_WL_images.tif", f"{folder}/a_WL_times.csv")


def test_the_record_is_checked(spark, series):
    folder, _, drift = series
    images = W.snapshots(W.snapshot_index(spark, f"{folder}/a_WL_images.tif", f"{folder}/a_WL_times.csv"))
    wrong = [(dx + (1.5 if k > 2 else 0), dy) for k, (dx, dy) in enumerate(drift)]  # a jump the sample never made
    record = spark.createDataFrame([(100.0 + 10 * k, 2.0 + dx, 7.0 + dy) for k, (dx, dy) in enumerate(wrong)], "t double, dx double, dy double")
    out = W.check_snapshots(images, record, 0.0, 2.5, (30, 30, 64, 64)).orderBy("snapshot").collect()
    assert [(r.record_dx, r.record_dy) for r in out] == [pytest.approx(p) for p in wrong]
    for r, (dx, dy) in zip(out, drift, strict=True):
        assert (r.dx, r.dy) == (pytest.approx(dx, abs=0.06), pytest.approx(dy, abs=0.06)) and r.quality > 0.7
