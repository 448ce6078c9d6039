"""What the jobs share: configs, tables that may not be there yet, folders of registered runs."""

from __future__ import annotations

import argparse
import json
import logging
import uuid
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from glimmer.session import shared_dir


def shipped_config(module_file: str) -> dict:
    """The config file beside a job."""
    return json.loads(Path(module_file).with_suffix(".json").read_text())


def read_config(spark: SparkSession, path: str | None, module_file: str) -> dict:
    """The shipped config, or that with the entries of a file, which may be remote."""
    config = shipped_config(module_file)
    if path:
        config |= json.loads(spark.read.text(path, wholetext=True).first()[0])
    return config


def given(spark: SparkSession, source: str, files: str) -> DataFrame:
    """The Parquet tables of a name pattern in the input folder, each a file or a folder of part
    files; where the folder holds none, the files of that name in its partition folders."""
    try:
        return spark.read.parquet(f"{source}/{files}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    return spark.read.option("pathGlobFilter", files).parquet(source)


def table_or_none(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame | None:
    """A Parquet table, or None if nothing was written there yet."""
    try:
        table = spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    names = StructType.fromDDL(schema).names if isinstance(schema, str) else schema.names
    return table.select(names)


def new_folder(spark: SparkSession, name: str) -> str:
    """A new, uniquely named folder under ``spark.checkpoint.dir``."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def command_line(description: str) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=description)
    parser.add_argument("--input", required=True, help="folder of the input files")
    parser.add_argument("--output", required=True, help="folder of the output tables")
    parser.add_argument("--config", help="JSON file whose entries replace those of the shipped config")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return parser.parse_args()
