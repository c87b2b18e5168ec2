"""From raw documents to packed training sequences, as stages that each read what the one before has written.

In every stage: rows without an id, repeated ids and repeated rows are documents of their own (only the similarity stage joins
rows, by their texts); an empty table gives an empty one; further columns of the input, whatever their names, pass through all
stages but the last, which has columns of its own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm._common import forget, stored, table
from marlstone.llm.decontaminate import without_contaminated
from marlstone.llm.jaccard import one_per_class
from marlstone.llm.packing import pack_documents
from marlstone.llm.suffix_dedup import without_repeats
from marlstone.llm.toxicity import train, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the scorer learns from labelled rows of this very input. Null and empty texts score like texts without terms; copies score alike."""
    return without_toxic(docs, train(docs, table(spark, sf_dir, "labels")))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar ones, that with the smallest id (of equal ids the first by text). Documents without words are like no other: of one id one stays, and all without an id stay."""
    return one_per_class(docs)


def suffix_array(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes that occur more than once; n_chars follows. A document of which nothing but white space is left goes; nulls, empty and shorter texts stay as they are."""
    return without_repeats(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which fewer than a twentieth of the words lie in benchmark windows; those without words stay. Without a benchmark all stay."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens; null and empty texts are one closing token. Ties are placed by id and piece."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 2048)


STAGES = [
    ("toxicity", toxicity),
    ("n-gram Jaccard join", ngram_jaccard),
    ("suffix-array dedup", suffix_array),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

#: A learned score, suffix arrays and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
