"""Token counts through a digest cache.

A stored table holds counts by (content digest, tokenizer digest). Contents are joined to it; only
distinct contents without a count are encoded, once each, and their counts are appended. The digest
is SHA-256 of the content as the tokenizer gets it: a null is the empty text, and nothing else is
normalised away, since case, space and composition all change token counts.

Empty texts count 0 tokens where the library says so; very long texts are encoded whole. Repeated
rows and equal texts share one encoding. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import hot_left_join, shared_dir, worker_store

CACHE_SCHEMA = "content string, tokenizer string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """Version of a tokenizer: SHA-256 of its file and the library that reads it."""
    library = "tokenizers" if path.endswith(".json") else "sentencepiece"
    version = __import__(library).__version__
    with open(path, "rb") as f:
        return hashlib.sha256(f"{library} {version} ".encode() + f.read()).hexdigest()


def _encoder(path: str):
    """A function from a list of texts to their token counts; the model is loaded once per worker process."""
    loaded = worker_store("tokenizers")
    if path not in loaded:
        if path.endswith(".json"):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            loaded[path] = lambda texts: [len(e.ids) for e in model.encode_batch(texts, add_special_tokens=False)]
        else:
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            loaded[path] = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    return loaded[path]


def encode_counts(texts: DataFrame, path: str, chunk: int = 64) -> DataFrame:
    """content, n_tokens for rows (content, text)."""

    def count(batches):
        import pyarrow as pa

        encode = _encoder(path)
        for batch in batches:
            values = batch.column(1).to_pylist()
            counts = [n for i in range(0, len(values), chunk) for n in encode(values[i : i + chunk])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["content", "n_tokens"])

    return texts.select("content", "text").mapInArrow(count, "content string, n_tokens long")


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; a cache that does not exist yet is begun empty."""
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(path)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def add_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, text_col: str = "text") -> None:
    """Encodes the contents of which the cache has no count, each once, and appends their counts."""
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer_path)
    known = open_cache(spark, cache_path).filter(F.col("tokenizer") == version).select("content").distinct()
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Distinct contents: copies collapse within each task before they travel, so a hot text is sent once a task.
    contents = docs.select(F.sha2(text, 256).alias("content"), text.alias("text")).groupBy("content").agg(F.min("text").alias("text"))
    new = encode_counts(contents.join(known, "content", "left_anti"), tokenizer_path).select("content", F.lit(version).alias("tokenizer"), "n_tokens")
    new.write.mode("append").parquet(cache_path)
    spark.catalog.refreshByPath(cache_path)


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit. Misses are encoded and appended to the cache before the join."""
    add_counts(docs, tokenizer_path, cache_path, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    counts = open_cache(docs.sparkSession, cache_path).filter(F.col("tokenizer") == tokenizer_digest(tokenizer_path))
    counts = counts.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))  # runs side by side may append one content twice
    rows = docs.select(id_col, F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("content"), F.monotonically_increasing_id().alias("_at"))
    joined = hot_left_join(rows, counts, ["content"], "_at")
    return joined.select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def count_tokens_once(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """With a cache of its own, in the shared folder, that an earlier delivery has begun: a sixteenth of the contents, by digest, is counted first and found in it when all are."""
    cache = shared_dir(docs.sparkSession, "token-counts")
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    add_counts(docs.filter(F.substring(digest, 1, 1) == "0"), tokenizer_path, cache, text_col)
    return count_tokens(docs, tokenizer_path, cache, text_col=text_col)
