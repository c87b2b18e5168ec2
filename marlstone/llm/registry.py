"""Registered queries of the training-data operators over the driver's tables."""

from __future__ import annotations

import public_tokenizers

from . import preference
from ._common import table
from .decontaminate import contaminated_documents
from .fingerprints import fingerprint_report
from .jaccard import jaccard_classes
from .merkle import proof_report
from .oracles import ORACLE
from .packing import pack_documents
from .sharding import shard_documents
from .simhash import simhash_classes
from .spelling import spelling_variants
from .suffix_dedup import suffix_report
from .token_counts import count_tokens_once
from .toxicity import score_documents, train
from .warc_zip import round_trip


def op1_document_fingerprints(spark, sf_dir):
    return fingerprint_report(table(spark, sf_dir, "documents"))


def op2_suffix_array_dedup(spark, sf_dir):
    return suffix_report(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))


def op5_token_counts(spark, sf_dir):
    return count_tokens_once(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_warc(spark, sf_dir):
    return round_trip(spark, table(spark, sf_dir, "pages"))


def op7_sharding(spark, sf_dir):
    return shard_documents(table(spark, sf_dir, "documents"), shards=16)


def op8_chat_formatting(spark, sf_dir):
    return preference.preference_report(table(spark, sf_dir, "conversations"))


def op9_benchmark_decontamination(spark, sf_dir):
    return contaminated_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_ngram_jaccard_join(spark, sf_dir):
    return jaccard_classes(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark, sf_dir):
    return proof_report(table(spark, sf_dir, "documents"))


def op12_simhash_near_dedup(spark, sf_dir):
    return simhash_classes(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark, sf_dir):
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_document_fingerprints,
        op2_suffix_array_dedup,
        op3_best_fit_packing,
        op4_toxicity,
        op5_token_counts,
        op6_warc,
        op7_sharding,
        op8_chat_formatting,
        op9_benchmark_decontamination,
        op10_ngram_jaccard_join,
        op11_merkle_manifest,
        op12_simhash_near_dedup,
        op13_spelling_variants,
    )
}

__all__ = ["ORACLE", "QUERIES"]
