"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import json
import sys
import tempfile
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Without that setting a session of one machine (master local) gets a folder of its own, and any other an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: lineage ends there."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes the files of stored tables (or of columns of them) that nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """What this process has freed goes back to the system."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def lean(rows):
    """For a function of batches: gives freed memory back at the end of a task. Workers outlive tasks, and what several stages in a row keep adds up."""

    @functools.wraps(rows)
    def run(batches):
        yield from rows(batches)
        give_back()

    return run


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salted_left_join(left: DataFrame, right: DataFrame, key: str | list[str], salt_from: str | Column, salts: int = 16) -> DataFrame:
    """Left join on ``key``, unique in ``right``, where few values of ``key`` may hold most rows of ``left``.

    Rows of ``left`` are dealt over ``salts`` copies of the right side, so that has to be much smaller. ``salt_from`` is the row's
    place where it was read, not its id, which many rows may lack or share.
    """
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    salt = F.pmod(F.xxhash64(salt_from), F.lit(salts)).cast("int")
    keys = [key] if isinstance(key, str) else key
    joined = left.withColumn("_salt", salt).join(right.withColumn("_salt", copies), [*keys, "_salt"], "left")
    return joined.drop("_salt")


def hot_left_join(left: DataFrame, right: DataFrame, keys: list[str], salt_from: str, counts: DataFrame | None = None, salts: int = 16, hot: int = 1_000) -> DataFrame:
    """The same for a right side as large as the left one: only keys with over ``hot`` rows are salted.

    ``counts`` (keys, _rows) saves counting them. Results are the same whatever is hot; there are at most rows / ``hot`` such keys.
    """
    if counts is None:
        counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    many = stored(counts.filter(F.col("_rows") > hot).select(*keys, F.lit(True).alias("_hot")), "hot-keys")
    if not many.limit(1).count():
        return left.join(right, keys, "left")
    salt = F.pmod(F.xxhash64(salt_from), F.lit(salts)).cast("int")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    marked = left.join(many, keys, "left").withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(F.lit(0))).drop("_hot")
    others = right.join(many, keys, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return marked.join(others, [*keys, "_salt"], "left").drop("_salt")


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Numbers and texts that the driver holds, as a table that the JVM reads from one JSON literal (createDataFrame would start Python workers)."""
    names = [c.split()[0] for c in schema.split(", ")]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    fields = ", ".join(c.replace(" ", ": ", 1) for c in schema.split(", "))
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{fields}>>")))


def worker_store(name: str) -> dict:
    """A dict that lives as long as the Python worker process, so later tasks find what earlier ones loaded."""
    module = sys.modules.setdefault("_worker_store", types.ModuleType("_worker_store"))
    return module.__dict__.setdefault(name, {})
