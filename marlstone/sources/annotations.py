"""Annotation files as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import ava_condition, ava_label
from ..operators.common import require_columns

FRAME_SCHEMA = "uri string, start_s double, end_s double, label string, split string, dataset string"
FRAME_COLUMNS = ["uri", "start_s", "end_s", "label", "split", "dataset"]
AVA_SCHEMA = "video_id string, start_s double, end_s double, label string"


def _fields(line: Column) -> Column:
    return F.split(F.regexp_replace(line, r"^\s+|\s+$", ""), r"\s+")


def parse_rttm(lines: DataFrame, dataset: str, split: str, line_col: str = "value") -> DataFrame:
    """Frame table of SPEAKER lines: different segments of each recording, empty and unreadable ones left out."""
    f = _fields(F.col(line_col))
    rows = lines.select(f.alias("f")).filter((F.size("f") >= 5) & (F.col("f")[0] == "SPEAKER"))
    start, length = F.expr("try_cast(f[3] AS DOUBLE)"), F.expr("try_cast(f[4] AS DOUBLE)")
    rows = rows.select(F.col("f")[1].alias("uri"), start.alias("start_s"), (start + length).alias("end_s")).filter("end_s > start_s").distinct()
    return rows.select("*", F.lit("SPEECH").alias("label"), F.lit(split).alias("split"), F.lit(dataset).alias("dataset"))


def parse_uem(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """uri, start_s, end_s of valid regions."""
    rows = lines.select(_fields(F.col(line_col)).alias("f")).filter(F.size("f") >= 4)
    rows = rows.select(F.col("f")[0].alias("uri"), F.expr("try_cast(f[2] AS DOUBLE)").alias("start_s"), F.expr("try_cast(f[3] AS DOUBLE)").alias("end_s"))
    return rows.filter("end_s > start_s")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_ava(spark: SparkSession, path: str, dataset: str, split: str) -> DataFrame:
    """Frame table with condition of a CSV file without header: video_id, start_s, end_s, label."""
    return ava_frames(spark.read.schema(AVA_SCHEMA).csv(path, header=False), dataset, split)


def ava_frames(rows: DataFrame, dataset: str, split: str) -> DataFrame:
    label = F.col("label")
    return rows.select(F.col("video_id").alias("uri"), "start_s", "end_s", ava_label(label).alias("label"), F.lit(split).alias("split"), F.lit(dataset).alias("dataset"), ava_condition(label).alias("condition"))


def write_frame_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    require_columns(df, FRAME_COLUMNS).write.mode(mode).parquet(path)


def read_frame_table(spark: SparkSession, path: str) -> DataFrame:
    return require_columns(spark.read.parquet(path), FRAME_COLUMNS)
