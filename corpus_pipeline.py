"""A training corpus from ``documents``: judged, deduplicated, cleaned of secrets, mixed and packed.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and
returns a frame that is written as Parquet and read again. All but the last return the columns of
``docs``, extra ones included.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm import best_fit, mixing, quality_rules, secret_scan, simhash_dups
from quarrystone.llm._shared import keep, scratch, table
from quarrystone.sources.shared import delete

_EVEN = {kind: dict.fromkeys(names, 1.0) for kind, names in zip(("source", "lang", "topic"), mixing.Targets().names(), strict=True)}
#: Nearly all tokens stay, so the targets are the corpus' own shares, tempered: large categories give to small ones.
MIX = mixing.Targets(source=_EVEN["source"], lang=_EVEN["lang"], topic=_EVEN["topic"], budget=0.9, temper=0.9)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; rows with a null id go by the base rules alone."""
    return quality_rules.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays."""
    return simhash_dups.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts give way to a mark; all documents stay."""
    return secret_scan.redact(docs, secret_scan.models_for(docs, table(spark, sf_dir, "labels")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with the weights of the targets; rows with a null id, which no sample can name, stay."""
    return mixing.keep(docs, MIX)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, in sequences of at most 2048 tokens."""
    packed = best_fit.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("simhash near-dedup", near_duplicates),
    ("secret scans", secrets),
    ("mixing to target weights", mixture),
    ("best-fit packing", packing),
]

#: Token ids and fingerprints are beyond SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's frame; what a stage leaves in the shared folder goes once its result is written there."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = keep(spark, name.replace(" ", "-"))
        with scratch(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
