"""Manifests and predictions from files, and their sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import clip_id_of_path
from ..operators.metrics import condition_metrics


#: Types of the columns that manifests and predictions may have; others are text.
COLUMN_TYPES = {
    **dict.fromkeys(("duration_ms", "sr", "container_duration_ms", "n_speech_frames", "n_total_frames", "segment_no"), "int"),
    **dict.fromkeys(("snr_db", "rms", "noise_amplitude", "t60", "start_s", "end_s", "score", "confidence", "p_first_token", "prob_A", "prob_B", "logit_A", "logit_B", "logit_diff", "max_prob", "min_prob", "mean_prob"), "double"),
    **dict.fromkeys(("correct", "is_normal"), "boolean"),
}


def _read(spark: SparkSession, path: str, fmt: str | None, types: dict[str, str] | None = None) -> DataFrame:
    """A CSV file's names come from its header, their types from COLUMN_TYPES and ``types``, so types do not depend on the rows and the rows are read once."""
    fmt = fmt or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")
    if fmt == "parquet":
        return spark.read.parquet(path)
    known = COLUMN_TYPES | (types or {})
    names = spark.read.csv(path, header=True).columns
    schema = ", ".join(f"`{c}` {known.get(c, 'string')}" for c in names)
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False)


def harmonise_manifest(df: DataFrame) -> DataFrame:
    """ground_truth from ``label`` where it lacks, clip_id from the file name."""
    cols = df.columns
    if "ground_truth" not in cols and "label" in cols:
        df = df.withColumn("ground_truth", F.col("label"))
    elif "ground_truth" in cols and "label" in cols:
        df = df.withColumn("ground_truth", F.coalesce("ground_truth", "label"))
    if "clip_id" not in cols:
        df = df.withColumn("clip_id", clip_id_of_path(F.col("audio_path")))
    return df


def read_manifest(spark: SparkSession, path: str, fmt: str | None = None, types: dict[str, str] | None = None) -> DataFrame:
    return harmonise_manifest(_read(spark, path, fmt, types))


def union_split_manifests(parts: dict[str, DataFrame]) -> DataFrame:
    """One table of several, with their split."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("split", F.lit(name)) for name, df in parts.items()])


def harmonise_predictions(df: DataFrame, run: str) -> DataFrame:
    """Adds run, and correct where the table has y_true and y_pred instead."""
    if "correct" not in df.columns:
        df = df.withColumn("correct", F.col("y_true") == F.col("y_pred"))
    if "ground_truth" not in df.columns:
        df = df.withColumn("ground_truth", F.col("label") if "label" in df.columns else F.col("y_true"))
    return df.withColumn("run", F.lit(run)).withColumn("correct", F.col("correct").cast("boolean"))


def union_predictions(parts: dict[str, DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [harmonise_predictions(df, run) for run, df in parts.items()])


def read_predictions(spark: SparkSession, paths: dict[str, str], fmt: str | None = None, types: dict[str, str] | None = None) -> DataFrame:
    """One long table of several prediction files; run is a column."""
    return union_predictions({run: _read(spark, path, fmt, types) for run, path in paths.items()})


def explode_prediction_arrays(df: DataFrame) -> DataFrame:
    """Other columns, position, prediction, ground_truth of rows with two parallel arrays."""
    keys = [c for c in df.columns if c not in ("predictions", "ground_truth")]
    zipped = F.arrays_zip("predictions", "ground_truth")
    return df.select(*keys, F.posexplode(zipped).alias("position", "z")).select(*keys, "position", F.col("z.predictions").alias("prediction"), F.col("z.ground_truth").alias("ground_truth"))


def read_prediction_arrays(spark: SparkSession, path: str, keys: str = "", multi_line: bool = True) -> DataFrame:
    """Documents with two parallel arrays, a row for each position; ``keys`` (a schema) names columns that tell documents apart."""
    schema = "predictions array<int>, ground_truth array<int>" + (f", {keys}" if keys else "")
    return explode_prediction_arrays(spark.read.schema(schema).json(path, multiLine=multi_line))


TEMPLATE_SCHEMA = "format string, label_space array<string>, description string, templates array<struct<id: string, text: string, mapping: map<string, string>, verbalizers: array<string>>>"


def read_prompt_templates(spark: SparkSession, path: str) -> DataFrame:
    """format, label_space, id, text, mapping, verbalizers: a row per template."""
    return explode_templates(spark.read.schema(TEMPLATE_SCHEMA).json(path, multiLine=True))


def explode_templates(docs: DataFrame) -> DataFrame:
    return docs.select("format", "label_space", F.explode("templates").alias("t")).select("format", "label_space", "t.*")


def read_jsonl_log(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def append_jsonl_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def manifest_from_files(files: DataFrame, label: str, source: str, duration_ms: int = 1000, path_col: str = "path") -> DataFrame:
    return files.select(clip_id_of_path(F.col(path_col)).alias("clip_id"), F.col(path_col).alias("audio_path"), F.lit(label).alias("ground_truth"), F.lit(source).alias("source"), F.lit(duration_ms).alias("duration_ms"), F.lit(None).cast("double").alias("snr_db"))


def write_splits(df: DataFrame, path: str, fmt: str = "parquet", split: str = "split", mode: str = "errorifexists") -> None:
    """A folder for each split."""
    df.write.mode(mode).partitionBy(split).format(fmt).options(**({"header": True} if fmt == "csv" else {})).save(path)


def metrics_document(df: DataFrame, settings: dict | None = None, type_col: str = "variant_type", cond_col: str = "condition", digits: int | None = None) -> DataFrame:
    """One row, one JSON document of predictions: settings, n_samples, overall, and by_variant_type, each with its conditions.

    Levels are one pass of grouping sets; the document is built as maps and written by ``to_json`` once, so any key is quoted.
    Types and conditions are few. Rows without a type or condition count above that level only.
    """
    flat = condition_metrics(df.withColumnsRenamed({type_col: "variant_type", cond_col: "condition"}))
    number = lambda c: F.col(c) if digits is None else F.round(c, digits)
    rising = lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    by_key = lambda e: F.map_from_entries(F.array_sort(F.collect_list(e), rising))
    shares = [number("ba").alias("ba"), number("acc_pos").alias("speech_acc"), number("acc_neg").alias("nonspeech_acc")]
    counts = [F.col("n").alias("n_samples"), F.col("n_pos").alias("n_speech"), F.col("n_neg").alias("n_nonspeech")]
    cells = flat.filter("level = 0 and variant_type is not null and condition is not null")
    entry = F.struct(F.col("condition").cast("string").alias("key"), F.struct(*shares, *counts).alias("value"))
    conditions = cells.groupBy("variant_type").agg(by_key(entry).alias("conditions"))
    types = flat.filter("level = 1 and variant_type is not null").join(conditions, "variant_type", "left")
    entry = F.struct(F.col("variant_type").cast("string").alias("key"), F.struct(*shares, counts[0], "conditions").alias("value"))
    types = types.agg(by_key(entry).alias("by_variant_type"))
    overall = flat.filter("level = 3").select(counts[0], F.struct(*shares).alias("overall"))
    row = overall.join(F.broadcast(types))  # one row each
    given = [F.lit(v).alias(k) for k, v in (settings or {}).items()]
    return row.select(F.to_json(F.struct(*given, "n_samples", "overall", "by_variant_type")).alias("document"))
