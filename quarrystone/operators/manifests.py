"""Signed manifests: envelopes of a payload, the key's name and an Ed25519 signature over the canonical rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ed25519, json_kernels, schema, text

#: What an envelope names itself, and what is put before each message, so that no signature serves for anything else.
ENVELOPE, CONTEXT = "archive-manifest-envelope.v1", b"ARCHIVE-MANIFEST-V1\x00"
_FIELDS = ["algorithm", "key_id", "payload", "schema", "signature"]


def _unsigned(key_id: Column, payload: Column) -> Column:
    """The canonical text of an envelope without its signature, around a canonical payload."""
    return F.concat(F.lit('{"algorithm":"Ed25519","key_id":'), text.json_text(key_id), F.lit(',"payload":'), payload, F.lit(f',"schema":"{ENVELOPE}"}}'))


def _wire(c: Column) -> Column:
    """Bytes in URL-safe base64 without padding."""
    return F.rtrim(F.translate(F.regexp_replace(F.base64(c), "\\s", ""), "+/", "-_"), F.lit("="))


def _unwired(c: Column) -> Column:
    """The bytes of URL-safe base64; null for anything else."""
    plain = F.translate(c, "-_", "+/")
    padded = F.rpad(plain, F.length(plain) + (4 - F.length(plain) % 4) % 4, F.lit("="))
    return F.when(c.rlike("^[A-Za-z0-9_-]*$") & (F.length(c) % 4 != 1), F.unbase64(padded))


def _apart(c: Column) -> Column:
    """``c`` in a step of its own: the planner doesn't find a UDF on the result of another one inside lambdas."""
    return F.explode(F.array(c))


def signed(manifests: DataFrame, key_id: str, secret: bytes) -> DataFrame:
    """``manifests`` (payload: JSON, and more) with ``envelope`` and ``problem``: a payload that has no canonical form, or not that of a manifest, isn't signed.

    The secret goes to the tasks with the plan; public keys are ``ed25519.public_of`` it.
    """
    canonical = manifests.withColumn("_c", json_kernels.canonical("payload"))
    faults = F.get(schema.faults(schema.MANIFEST, F.col("_c.canonical")), F.lit(0))
    told = canonical.withColumn("_fault", faults)
    problem = F.when(F.col("payload").isNull(), "payload").when(F.col("_c.problem").isNotNull(), F.concat_ws(" ", "_c.path", "_c.problem")).when(F.col("_fault").isNotNull(), F.concat_ws(" ", "_fault.path", "_fault.rule"))
    ready = told.withColumn("problem", problem).withColumn("_unsigned", F.when(F.col("problem").isNull(), _unsigned(F.lit(key_id), F.col("_c.canonical"))))
    message = ready.withColumn("_message", _apart(F.concat(F.lit(CONTEXT), F.col("_unsigned").cast("binary"))))
    sealed = message.withColumn("_bytes", ed25519.signed(secret)("_message")).withColumn("_signature", _wire(F.col("_bytes")))
    end = F.concat(F.lit(',"signature":"'), F.col("_signature"), F.lit('"}'))
    envelope = F.concat(F.substring("_unsigned", F.lit(1), F.length("_unsigned") - 1), end)
    return sealed.withColumn("envelope", envelope).select(*manifests.columns, "envelope", "problem")


def verified(envelopes: DataFrame, key_id: str, public: bytes) -> DataFrame:
    """``envelopes`` (envelope: JSON, and more) with ``problem``, the first of: fields, version, key, payload, the payload's first fault, signature; null if there is none.

    What was signed is the canonical form of all but the signature, so spaces and the order of keys don't matter.
    """
    part = lambda name: F.try_variant_get("_v", f"$.{name}", "string")
    read = envelopes.withColumn("_v", F.try_parse_json("envelope"))
    payload = F.to_json(F.try_variant_get("_v", "$.payload", "variant"))
    keys = F.array_sort(F.map_keys(F.try_variant_get("_v", "$", "map<string,variant>")))
    cut = read.withColumns({"_keys": keys, "_payload": F.when(payload.startswith("{"), payload), "_signature": _unwired(part("signature"))})
    faults = F.get(schema.faults(schema.MANIFEST, F.col("_payload")), F.lit(0))
    told = cut.withColumn("_fault", faults).withColumn("_c", json_kernels.canonical("_payload"))
    message = F.concat(F.lit(CONTEXT), _unsigned(part("key_id"), F.col("_c.canonical")).cast("binary"))
    held = told.withColumn("_message", _apart(message)).withColumn("_holds", ed25519.verified(public)("_message", "_signature"))
    problem = (
        F.when(~F.coalesce(F.col("_keys") == F.array(*map(F.lit, _FIELDS)), F.lit(False)), "fields")
        .when(~F.coalesce((part("schema") == ENVELOPE) & (part("algorithm") == "Ed25519"), F.lit(False)), "version").when(~F.coalesce(part("key_id") == key_id, F.lit(False)), "key").when(F.col("_payload").isNull(), "payload")
        .when(F.col("_fault").isNotNull(), F.concat_ws(" ", "_fault.path", "_fault.rule")).when(~F.col("_holds"), "signature")
    )
    return held.withColumn("problem", problem).select(*envelopes.columns, "problem")
