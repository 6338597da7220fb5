"""A corpus pipeline of five stages. Each takes (spark, docs, sf_dir) and works on all that the stage before it kept.

The first four return the columns of ``documents``; the last one returns the encoded documents. Between stages the rows are written as Parquet and
read again, so that no stage depends on the lineage of another, and what a stage wrote on its way is deleted. Each begins with small executors: the
garbage that the one before it left in their heaps is collected.

Defined results, for every stage: a null or empty text is a text like any other (the first stages keep it, the last encodes it as begin and end); a null
id stays where a stage drops by id, and loses against another id of an equal text; a null source or language is one of its own; repeated rows are
judged alike, and rows that repeat id and text are one document from the stage exact_dedup on; very long texts are processed whole; an empty table gives
an empty table; all columns of the input come back from the first four stages, whatever their names, and the last one gives its own.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, jaccard_join, mixing, quality, sentencepiece_codec
from tessera.llm.common import table
from tessera.session import free_heaps
from tessera.storage import release, stored, written

#: The vocabulary file of the last stage; None takes the public 32k model of the machine.
TOKENIZER: str | None = None


def _tokenizer() -> str:
    if TOKENIZER:
        return TOKENIZER
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _afresh(stage: Callable) -> Callable:
    """``stage`` on executors whose heaps hold only what lives. A heap that has grown in one stage leaves the Python workers of the next too little."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        free_heaps(spark)
        return stage(spark, docs, sf_dir)

    return run


@_afresh
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models of trusted text do not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


@_afresh
def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.dedup(docs)


@_afresh
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles link at a Jaccard similarity of 0.8 or more."""
    return jaccard_join.keep_one(docs, words=5, percent=80)


@_afresh
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out to the square-root weights of their sources, globally shuffled."""
    return mixing.mix(docs)


@_afresh
def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, piece_ids with begin and end, n_tokens, and whether decoding gives the text back (its U+2581 as blanks)."""
    coded = sentencepiece_codec.encode(docs.select("doc_id", "lang", "source", "text"), _tokenizer(), round_trip="round_trip")
    return coded.select("doc_id", "lang", "source", "piece_ids", F.size("piece_ids").cast("long").alias("n_tokens"), "round_trip")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_duplicates),
    ("ngram_jaccard_join", near_duplicates),
    ("source_mix", source_mix),
    ("sentencepiece", sentencepiece),
]

#: Language models and similarity joins are beyond SQL; tests/llm/test_pipeline.py holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = written()
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, since=before, but=1)
    return STAGES[-1][1](spark, docs, sf_dir)
