"""The operators' queries with the columns of their contracts, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_fit, gif_media, hash_tree, html_wrappers, id_files, mixing, oracles, periodic_runs, quality_rules, secret_scan, simhash_dups, token_counts, url_filter, whitening
from ._shared import table

MAX_TOKENS, SHARDS, COMPONENTS = 1024, 24, 32


def op1_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_wrappers.main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > MAX_TOKENS)


def op3_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif_media.store_and_read(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sample(table(spark, sf_dir, "documents")).withColumn("keep_prob", F.round("keep_prob", 6))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scanned = secret_scan.scan(docs, secret_scan.models_for(docs, table(spark, sf_dir, "labels")))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scanned.select("doc_id", of("assign"), of("access"), of("hex"), "base_sha256", text.alias("spans"))


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = best_fit.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dups.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_files.write_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op10_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tree = table(spark, sf_dir, "documents"), hash_tree.regular_tree(SHARDS)
    placed = hash_tree.assign(hash_tree.assign(docs, tree), hash_tree.grown(tree), "grown_shard")
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = placed.select("doc_id", (F.length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.lit("key").alias("law"), "shard", "grown_shard")
    numbered = hash_tree.number(rows, ["doc_id", "size", "text_crc32"])
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def op11_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs.find(docs.select("doc_id", periodic_runs.with_repetitions(F.col("text"), F.col("doc_id")).alias("text")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    best = periodic_runs.strongest(F.col("runs"))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


#: Host, path and verdict.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def op12_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, url_filter.SCHEMA))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op13_svd_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = whitening.whiten(table(spark, sf_dir, "embeddings"), COMPONENTS)
    shares = F.array(*map(F.lit, model.explained[:COMPONENTS])) if model else F.lit(None).cast("array<double>")
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(model.error if model else 0.0).alias("identity_error"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_html_wrappers, op2_token_counts, op3_gif_media, op4_mixing, op5_quality_rules, op6_secret_scan, op7_best_fit, op8_simhash, op9_id_files, op10_hash_tree, op11_lyndon_runs, op12_url_rules, op13_svd_whitening)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": oracles.mixing_sql(), "op5_quality_rules": oracles.quality_sql(), "op12_url_rules": oracles.rules_sql(RULES)}
