"""The jobs over growing input, awkward rows, stopped runs and reruns."""

import json
import os
import shutil
import subprocess
import sys

import pandas as pd
import pytest
from pyspark.sql import functions as F

from jobs import filter_report as report
from jobs import live_reconstruction as live
from jobs.common import read_config, shipped_config, table_or_none

TABLES = "/root/testdata/sf0.001"
LIVE, REPORT = shipped_config(live.__file__), shipped_config(report.__file__)


@pytest.fixture()
def parts(spark, tmp_path):
    """The given lineitem in three files, to be put into the input folder one after another."""
    rows = pd.read_parquet(f"{TABLES}/lineitem.parquet")
    (tmp_path / "in").mkdir()
    third = len(rows) // 3

    def put(k: int) -> None:
        rows.iloc[k * third : (k + 1) * third].to_parquet(tmp_path / "in" / f"lineitem_{k}.parquet")

    put.rows, put.third, put.source, put.output = rows, third, str(tmp_path / "in"), str(tmp_path / "out")
    return put


def image_of(rows: pd.DataFrame) -> dict:
    o, p, s, n = (rows[f"l_{c}"] for c in ("orderkey", "partkey", "suppkey", "linenumber"))
    f = pd.DataFrame({"frame": (o * 13 + p * 7 + n) % 1000, "x": (p * 7919 + o * 31) % 64000 / 1000, "y": (s * 104729 + o * 17 + n * 977) % 64000 / 1000, "sigma": 100 + p % 150, "photons": rows["l_quantity"].astype(float) * 40 + 200, "best": 8 + (s * 7 + o) % 32})
    f = f[f["sigma"].between(110, 240) & (f["photons"] >= 300) & (f["best"] <= 36) & (f["x"] < 63.5) & (f["y"] < 63.5)]
    g = f.groupby([f["frame"] // 100, ((f["y"] + 0.5) * 2).astype(int), ((f["x"] + 0.5) * 2).astype(int)])
    return {k: (len(v), v["photons"].sum(), float(v["best"].min())) for k, v in g}


def found(image) -> dict:
    return {(r.movie_frame, r.row, r.col): (r.n, r.photons, r.best_nm) for r in image.collect()}


def stamps(folder: str) -> dict:
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_growing_input(spark, parts, caplog):
    caplog.set_level("INFO")
    parts(0)
    assert found(live.run(spark, parts.source, parts.output, LIVE)) == image_of(parts.rows[: parts.third])
    parts(1)
    parts(2)
    caplog.clear()
    assert found(live.run(spark, parts.source, parts.output, LIVE)) == image_of(parts.rows[: 3 * parts.third])
    assert f"read {2 * parts.third} new rows" in caplog.text  # and not the first file again
    before = stamps(parts.output)
    caplog.clear()
    live.run(spark, parts.source, parts.output, LIVE)
    assert "read 0 new rows, drew 0 blocks" in caplog.text and stamps(parts.output) == before


def test_only_blocks_with_new_rows_are_drawn(spark, parts):
    parts(0)
    live.run(spark, parts.source, parts.output, LIVE)
    before = stamps(f"{parts.output}/image")
    late = parts.rows[(parts.rows["l_orderkey"] * 13 + parts.rows["l_partkey"] * 7 + parts.rows["l_linenumber"]) % 1000 // 100 == 4]
    late.to_parquet(f"{parts.source}/lineitem_late.parquet")
    got = found(live.run(spark, parts.source, parts.output, LIVE))
    assert got == image_of(pd.concat([parts.rows[: parts.third], late]))
    after = stamps(f"{parts.output}/image")
    assert {k for k in before if "movie_frame=4/" not in k} <= set(after)
    assert all(after[k] == before[k] for k in before if "movie_frame=4/" not in k)


def test_a_stopped_run_is_made_good(spark, parts, monkeypatch):
    parts(0)
    with monkeypatch.context() as m:  # stopped after the stream, before anything is drawn
        m.setattr(live, "draw", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            live.run(spark, parts.source, parts.output, LIVE)
    assert table_or_none(spark, f"{parts.output}/image", live.IMAGE) is None
    assert found(live.run(spark, parts.source, parts.output, LIVE)) == image_of(parts.rows[: parts.third])
    parts(1)
    live.take_new(spark, parts.source, parts.output, LIVE)
    held = spark.read.parquet(f"{parts.output}/localizations")
    first = live.changed_blocks(spark, held, parts.output).count()
    assert first > 0 and live.draw(spark, parts.source, parts.output, LIVE) == first
    shutil.rmtree(f"{parts.output}/blocks/movie_frame=3")  # drawn but not recorded: drawn again
    assert live.draw(spark, parts.source, parts.output, LIVE) == 1
    assert found(live.run(spark, parts.source, parts.output, LIVE)) == image_of(parts.rows[: 2 * parts.third])


def test_small_batches_and_rows_without_places(spark, parts):
    parts(0)
    odd = parts.rows[:4].astype({"l_partkey": "Int64", "l_suppkey": "Int64"}).copy()
    odd["l_partkey"] = pd.array([None] * 4, "Int64")
    odd.to_parquet(f"{parts.source}/lineitem_odd.parquet")
    parts(1)
    got = live.run(spark, parts.source, parts.output, LIVE | {"files_per_batch": 1})
    assert found(got) == image_of(parts.rows[: 2 * parts.third])


def test_nothing_that_passes(spark, parts):
    parts(0)
    assert live.run(spark, parts.source, parts.output, LIVE | {"bounds": {"photons": [1e9, None]}}).count() == 0


def test_registered_jobs_leave_settings_and_use_new_folders(spark):
    names = ("spark.sql.sources.partitionOverwriteMode", "spark.sql.shuffle.partitions", "spark.sql.streaming.schemaInference")
    before = [spark.conf.get(n, None) for n in names]
    folder = spark.conf.get("spark.checkpoint.dir")
    a = live.job1_live_reconstruction(spark, TABLES)
    b = live.job1_live_reconstruction(spark, TABLES)
    assert found(a) == found(b) == image_of(pd.read_parquet(f"{TABLES}/lineitem.parquet"))
    assert len([f for f in os.listdir(folder) if f.startswith("job1-")]) >= 2
    assert [spark.conf.get(n, None) for n in names] == before and not spark.streams.active


# --- the filter report ------------------------------------------------------------------------

ODD = [
    (1, "one two three four five six", "en", "a"), (1, "one two three four five six", "en", "a"), (2, None, None, None), (3, "", "", "01"), (4, "12345 " * 50, "en", "1"),
    (5, "word " * 5000, "en", "a"), (None, "eins zwei drei vier fünf\nsechs", "de", None), (6, " \n ", "de", "a/b=c"), (7, "a b c d e f g", "de", "a/b=c"), (8, "ab cd ef gh ij kl", "de", "a/b=c"),
]


def words(text):
    return text.replace("\n", " ").split()


def test_awkward_rows(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string").withColumn("m_words", F.lit(-1)).write.parquet(f"{folder}/documents")
    config = REPORT | {"files": "*.parquet"}
    runs = []
    for _ in range(2):
        out = report.run(spark, f"{folder}/documents", str(tmp_path / "out"), config)
        runs.append({name: sorted(map(str, df.collect())) for name, df in out.items()})
    assert runs[0] == runs[1]
    kept = sorted((r.doc_id or 0, r.lang, r.source, r.text) for r in out["kept"].collect())
    assert kept == sorted([(1, "en", "a", ODD[0][1]), (1, "en", "a", ODD[0][1]), (0, "de", "", ODD[6][1]), (8, "de", "a/b=c", ODD[9][1])])
    bounds = {r.measure: (r.low, r.high) for r in out["bounds"].collect()}
    assert bounds["words"] == (5, 5000) and bounds["chars"] == (0, 20000) and bounds["lines"] == (1, 2)
    bins = {(r.measure, r.of, r.bin): (r.n_all, r.n_kept) for r in out["histograms"].collect()}
    assert bins["words", "en", 0] == (3, 2) and bins["words", "en", 50] == (1, 0) and bins["words", "", 0] == (2, 0)
    assert sum(n for (m, _, _), (n, _) in bins.items() if m == "words") == len(ODD)
    assert sum(n for (m, _, _), (n, _) in bins.items() if m == "word_length") == sum(bool(words(t or "")) for _, t, _, _ in ODD)


@pytest.mark.parametrize("places", [["documents.parquet/part-0000.parquet", "documents.parquet/part-0001.parquet", "documents_2.parquet", "labels.parquet/part-0000.parquet"], ["day=1/documents.parquet", "day=2/documents.parquet", "day=2/documents_2.parquet"]])
def test_tables_of_part_files_and_partition_folders(spark, tmp_path, places):
    for k, place in enumerate(places):  # other tables of the folder are not read
        (tmp_path / "in" / place).parent.mkdir(parents=True, exist_ok=True)
        rows = pd.DataFrame({"doc_id": [2 * k, 2 * k + 1], "text": ["one two three four five six", "too short"], "lang": "en", "source": "a"})
        rows.to_parquet(tmp_path / "in" / place)
    out = report.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), REPORT)
    assert sorted(r.doc_id for r in out["measures"].collect()) == list(range(6))
    assert sorted(r.doc_id for r in out["kept"].collect()) == [0, 2, 4]


def test_a_group_that_is_gone(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string"
    good = "one two three four five six"
    for rows in ([(1, good, "en", "a"), (2, good, "fr", "b")], [(1, good, "en", "a")]):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(str(tmp_path / "in"))
        out = report.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), REPORT | {"files": "*.parquet"})
    assert [r.lang for r in out["kept"].collect()] == ["en"]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "in"))
    out = report.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), REPORT | {"files": "*.parquet"})
    assert out["kept"].count() == out["histograms"].count() == 0 and out["bounds"].count() == len(REPORT["measures"])


def test_command_line(spark, tmp_path):
    config = tmp_path / "more.json"
    config.write_text(json.dumps({"bounds": {"words": [100, None]}}))
    assert read_config(spark, str(config), report.__file__)["groups"] == ["lang", "source"]
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run(
        [sys.executable, "-m", "jobs.filter_report", "--input", TABLES, "--output", str(tmp_path / "out"), "--config", str(config)],
        cwd=root, capture_output=True, text=True, timeout=240, env=os.environ | {"PYTHONPATH": root})
    assert done.returncode == 0, done.stderr[-2000:]
    assert "wrote" in done.stderr and "bounds" in done.stderr
    kept = spark.read.parquet(f"{tmp_path}/out/kept")
    docs = pd.read_parquet(f"{TABLES}/documents.parquet")
    assert kept.count() == sum(len(words(t)) >= 100 for t in docs["text"])
