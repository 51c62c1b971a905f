"""Content-addressed objects: deduplication, garbage, manifests, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import digest_hex, digest_wire, exact_keys


def dedup_report(assets: DataFrame) -> DataFrame:
    """One row: references, unique objects, logical, unique and saved bytes, duplicates, missing."""
    per = assets.where("digest is not null").groupBy("digest").agg(F.count("*").alias("n"), F.sum("bytes").alias("all"), F.min_by("bytes", "id").alias("one"))
    total = per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("references"), F.count("*").alias("unique_objects"), F.coalesce(F.sum("all"), F.lit(0)).alias("logical_bytes"),
        F.coalesce(F.sum("one"), F.lit(0)).alias("unique_bytes"),
    )
    missing = assets.agg(F.count_if(F.col("digest").isNull()).alias("missing"))
    out = total.crossJoin(missing)  # single rows
    return out.withColumns({"saved_bytes": F.col("logical_bytes") - F.col("unique_bytes"), "duplicate_references": F.col("references") - F.col("unique_objects")})


def stored_objects(assets: DataFrame) -> DataFrame:
    """Objects as they are put: once for each digest, with path and prefix."""
    one = assets.groupBy("digest").agg(F.min_by(F.struct("id", "bytes"), "id").alias("r"))
    return one.select("digest", "r.id", "r.bytes", F.concat(F.lit("_objects/sha256/"), F.substring("digest", 1, 2), F.lit("/"), F.col("digest")).alias("path"))


def unsafe_path(p: Column) -> Column:
    return p.startswith("/") | F.array_contains(F.split(p, "/"), "..") | (p == "")


def garbage(objects: DataFrame, references: list[DataFrame], links: DataFrame | None = None) -> DataFrame:
    """Objects with ``state``: protected by a reference, shared with other files, or reclaimable."""
    digests = references[0].select("digest")
    for r in references[1:]:
        digests = digests.unionByName(r.select("digest"))
    kept = digests.where("digest is not null").distinct().withColumn("kept", F.lit(True))
    rows = objects.join(kept, "digest", "left")
    if links is not None:
        rows = rows.join(links.select("digest", "links"), "digest", "left")
    n = F.coalesce(F.col("links"), F.lit(1)) if links is not None else F.lit(1)
    return rows.withColumn("state", F.when(F.col("kept"), "protected").when(n > 1, "shared").otherwise("reclaimable")).drop("kept")


def inventory_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """path, state: ok, missing, unlisted, size or digest, by a full join of two inventories (path, bytes, digest)."""
    e = expected.select("path", F.col("bytes").alias("e_bytes"), F.col("digest").alias("e_digest"))
    a = actual.select("path", F.col("bytes").alias("a_bytes"), F.col("digest").alias("a_digest"))
    both = e.join(a, "path", "full")
    state = F.when(F.col("a_bytes").isNull(), "missing").when(F.col("e_bytes").isNull(), "unlisted").when(F.col("a_bytes") != F.col("e_bytes"), "size").when(~F.col("a_digest").eqNullSafe(F.col("e_digest")), "digest").otherwise("ok")
    return both.select("path", state.alias("state"))


def manifests(snapshots: DataFrame, assets: DataFrame) -> DataFrame:
    """run_id, pages, resources, payload: a run's pages by id, and its resources, as canonical JSON.

    A run's lists are bounded by the pages of a capture.
    """
    pages = snapshots.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("id", F.col("source_url").alias("url"), digest_wire(F.col("digest")).alias("digest"), "bytes"))).alias("pages"))
    mine = assets.join(snapshots.select(F.col("id").alias("snapshot_id"), "run_id"), "snapshot_id")
    resources = mine.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("id", digest_wire(F.col("digest")).alias("digest"), "bytes"))).alias("resources"))
    rows = pages.join(resources, "run_id", "left").withColumn("resources", F.coalesce("resources", F.array().cast("array<struct<id:bigint,digest:string,bytes:bigint>>")))
    return rows.withColumn("payload", F.to_json(F.struct("pages", "resources", "run_id")))


def protected(manifests_: DataFrame) -> DataFrame:
    """digest (hex): every page and resource that the given manifests name."""
    named = lambda c: manifests_.select(F.explode(c).alias("x")).select(digest_hex(F.col("x.digest")).alias("digest"))
    return named("pages").unionByName(named("resources")).distinct()


def valid_manifest(pages: Column, resources: Column) -> Column:
    """Digests in wire form, sizes that JSON numbers hold, no id twice."""
    wire = lambda x: x["digest"].rlike(r"^sha256:[A-Za-z0-9_-]{43}$") & (x["bytes"] >= 0) & (x["bytes"] <= (1 << 53) - 1)
    once = lambda a: F.size(F.array_distinct(F.transform(a, lambda x: x["id"]))) == F.size(a)
    return F.forall(pages, wire) & F.forall(resources, wire) & once(pages) & once(resources)


#: The fields of a signed envelope and its algorithm.
ENVELOPE, ALGORITHM = ("algorithm", "key_id", "payload", "schema", "signature"), "Ed25519"


def envelope_problem(json: Column, schema: str, key_id: Column) -> Column:
    """What is wrong with an envelope up to its signature: fields, version, key, payload or signature; null if nothing is."""
    of = lambda f: F.get_json_object(json, f"$.{f}")
    return (
        F.when(~exact_keys(json, list(ENVELOPE)), "fields").when(~(of("schema").eqNullSafe(F.lit(schema)) & of("algorithm").eqNullSafe(F.lit(ALGORITHM))), "version")
        .when(~of("key_id").eqNullSafe(key_id), "key").when(~F.coalesce(of("payload").startswith("{"), F.lit(False)), "payload")
        .when(~F.coalesce(of("signature").rlike("^[A-Za-z0-9_-]{86}$"), F.lit(False)), "signature")
    )


def referential_audit(parent: DataFrame, parent_key: str, child: DataFrame, child_key: str) -> DataFrame:
    """Rows of ``child`` whose key has no parent."""
    return child.join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def duplicate_ids(assets: DataFrame) -> DataFrame:
    """snapshot_id, id, n: ids that one snapshot uses more than once."""
    return assets.groupBy("snapshot_id", "id").agg(F.count("*").alias("n")).where("n > 1")
