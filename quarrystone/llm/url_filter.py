"""Rules on addresses: allow and block lists of hosts and path beginnings, looked up by short hashes.

An address is expanded into expressions, a suffix of its host's labels with a beginning of its path, in the shapes (number of
labels, length of path) that the rules have. An expression and a rule meet by the first BITS bits of their SHA-256
digests, an equi-join on short keys; the full digests then confirm it, and of all rules that fit, the longest one decides.

Rows are counted by id and address first: one shuffle of ids and addresses, within whose partitions the expressions
are then expanded, joined and gathered again. Rules are broadcast up to a measured size. Beyond that they are dealt out SALTS times each, so that a
rule that fits a third of all addresses is no single task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import BROADCAST_BYTES

BITS, SALTS = 32, 64
#: Copies of a repeated row that are restored together.
COPIES = 1 << 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCHEMA = "host string, path string, verdict string"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in small letters, and what follows that up to ``?``, ``#`` or the end.

    Both are empty for null and for addresses without ``://``.
    """
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _rules(rules: DataFrame) -> DataFrame:
    """Rules that can fit an address, each once; of two equal ones the one that blocks."""
    host = F.translate(F.col("host"), _UPPER, _LOWER)
    usable = F.col("verdict").isin("allow", "block") & ~host.rlike("[/?#]") & F.col("path").rlike("^(?:/[^?#]*)?$")
    named = rules.where(usable).groupBy(host.alias("host"), "path").agg(F.max("verdict").alias("verdict"))
    rule = F.concat("host", "path")
    return named.select(rule.alias("_rule"), "verdict", F.length("host").alias("_host_chars"), _labels(F.col("host")).alias("_labels"), F.length("path").alias("_chars"), F.sha2(rule, 256).alias("_whole"), F.left(F.sha2(rule, 256), F.lit(BITS // 4)).alias("_short"))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """A row per row of ``pages``: id, address, ``host``, ``path``, ``rule`` (host and path of the one that decides; else null), ``verdict``.

    ``rules`` has host, path and verdict (allow or block). A rule fits its host and all subdomains if the path starts with
    its path; the longest decides, of equally long ones the one with the longer host, of equal ones the one that blocks. ``default`` is
    the verdict where none fits. Rules with a null, with another verdict, with ``/``, ``?`` or ``#`` in the host, or with a path that is neither
    empty nor begins with ``/``, fit nothing.

    Null and malformed addresses have an empty host and path. Repeated rows stay as often as they are, null ids too; no
    rules at all give every row the default. Further columns aren't returned, whatever their names.
    """
    known = _rules(rules)
    size = known.agg(F.coalesce(F.sum(F.length("_rule") + 160), F.lit(0))).first()[0]
    shapes = known.agg(F.collect_set(F.struct("_labels", "_chars")).alias("_shapes"))
    host, path = host_and_path(F.col("_url"))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")).groupBy("_id", "_url").agg(F.count("*").alias("_n"))
    rows = rows.withColumns({"_host": host, "_path": path}).crossJoin(F.broadcast(shapes))
    fitting = F.filter("_shapes", lambda s: (s["_labels"] <= _labels(F.col("_host"))) & (s["_chars"] <= F.length("_path")))
    rows = rows.select("_id", "_url", "_n", "_host", "_path", F.explode_outer(fitting).alias("_shape"))
    suffix = F.call_function("substring_index", F.col("_host"), F.lit("."), -F.col("_shape._labels"))
    digest = F.sha2(F.concat(suffix, F.substring("_path", F.lit(1), F.col("_shape._chars"))), 256)
    rows = rows.select("_id", "_url", "_n", "_host", "_path", digest.alias("_digest")).withColumn("_short", F.left("_digest", F.lit(BITS // 4)))
    known = known.drop("_labels", "_chars")
    if size <= BROADCAST_BYTES:
        met = rows.join(F.broadcast(known), "_short", "left")
    else:
        dealt = known.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        met = rows.withColumn("_salt", F.pmod(F.xxhash64("_id", "_url"), F.lit(SALTS)).cast("int")).join(dealt, ["_short", "_salt"], "left")
    fits = F.when(F.col("_digest") == F.col("_whole"), F.struct(F.length("_rule").alias("chars"), F.col("_host_chars"), F.col("_rule"), F.col("verdict")))
    best = met.groupBy("_id", "_url").agg(F.first("_n").alias("_n"), F.first("_host").alias("host"), F.first("_path").alias("path"), F.max(fits).alias("_best"))
    blocks = best.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {COPIES}"))))
    every = blocks.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(COPIES).cast("long"), F.col("_n") - F.col("_block") * COPIES))))
    return every.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "host", "path", F.col("_best._rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))


def allowed(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Ids and addresses of the rows that the rules let through."""
    return judge(pages, rules, id_col, url_col, default).where("verdict = 'allow'").select(id_col, url_col)
