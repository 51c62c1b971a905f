"""JSON Schemas compiled to expressions over VARIANT: what fails, and where, without Python in any task.

A schema is walked once, on the driver, and gives one expression that holds as much as the schema does, whatever the documents
hold. Of the keywords type, const, enum, required, properties, additionalProperties, items, minItems, maxItems, uniqueItems,
pattern, minLength, maxLength, minimum, maximum, format (date-time, uri) and $ref (to ``#/...``, without cycles) all are checked, others raise an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import bound

_FAULTS = "array<struct<path:string,rule:string>>"
#: What the two formats look like.
FORMATS = {
    "date-time": r"^\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])[Tt](?:[01]\d|2[0-3]):[0-5]\d:(?:[0-5]\d|60)(?:\.\d+)?(?:[Zz]|[+-](?:[01]\d|2[0-3]):[0-5]\d)\z",
    "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s<>\"{}|\\^`]*\z",
}
_KNOWN = set("$schema $id $defs $comment title description type const enum required properties additionalProperties items minItems maxItems uniqueItems pattern minLength maxLength minimum maximum format $ref".split())


def _kind(v: Column) -> Column:
    """The JSON type of a variant, numbers without a fraction as ``integer``."""
    name = F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    number = F.when(F.coalesce(F.try_variant_get(v, "$", "double"), F.lit(0.5)) % 1 == 0, "integer").otherwise("number")
    return F.when(name == "OBJECT", "object").when(name == "ARRAY", "array").when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(name == "VOID", "null").otherwise(number)


def _fault(path: Column, rule: str, holds: Column) -> Column:
    """No fault where the rule holds."""
    return F.when(~F.coalesce(holds, F.lit(False)), F.array(F.struct(path.alias("path"), F.lit(rule).alias("rule"))))


def _some(parts: list[Column]) -> Column:
    return F.flatten(F.filter(F.array(*parts), lambda x: x.isNotNull())).cast(_FAULTS) if parts else F.array().cast(_FAULTS)


class Compiler:
    """Expressions for one schema document."""

    def __init__(self, root: dict):
        self.root = root

    def _resolved(self, schema: dict) -> dict:
        if not isinstance(schema, dict) or set(schema) - _KNOWN:
            raise ValueError(f"keywords that aren't known: {schema if not isinstance(schema, dict) else sorted(set(schema) - _KNOWN)}")
        if "$ref" not in schema:
            return schema
        node = self.root
        for name in schema["$ref"].removeprefix("#/").split("/"):
            node = node[name]
        return self._resolved(node) | {k: v for k, v in schema.items() if k != "$ref"}

    def faults(self, schema: dict, value: Column, path: Column) -> Column:
        """All faults of a variant that is there."""
        schema = self._resolved(schema)
        return bound(F.struct(value.alias("v"), path.alias("path"), _kind(value).alias("kind")), lambda x: self._of(schema, x))

    def _of(self, schema: dict, x: Column) -> Column:
        v, path, kind = x["v"], x["path"], x["kind"]
        parts = []
        if "type" in schema:
            types = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
            parts.append(_fault(path, "type", kind.isin(*types, *(["integer"] if "number" in types else []))))
        for rule in ("const", "enum"):
            if rule in schema:
                wanted = [schema[rule]] if rule == "const" else schema[rule]
                if not all(isinstance(w, str) for w in wanted):
                    raise ValueError(f"{rule} of texts only")
                parts.append(_fault(path, rule, (kind == "string") & F.try_variant_get(v, "$", "string").isin(*wanted)))
        if schema.keys() & {"pattern", "minLength", "maxLength", "format"}:
            parts.append(F.when(kind == "string", bound(F.try_variant_get(v, "$", "string"), lambda s: self._text(schema, s, path))))
        if schema.keys() & {"minimum", "maximum"}:
            n = F.try_variant_get(v, "$", "double")
            bounds = [_fault(path, "minimum", n >= float(schema["minimum"]))] if "minimum" in schema else []
            bounds += [_fault(path, "maximum", n <= float(schema["maximum"]))] if "maximum" in schema else []
            parts.append(F.when(kind.isin("integer", "number"), _some(bounds)))
        if schema.keys() & {"required", "properties", "additionalProperties"}:
            parts.append(F.when(kind == "object", bound(F.try_variant_get(v, "$", "map<string,variant>"), lambda m: self._object(schema, m, path))))
        if schema.keys() & {"items", "minItems", "maxItems", "uniqueItems"}:
            parts.append(F.when(kind == "array", bound(F.try_variant_get(v, "$", "array<variant>"), lambda a: self._array(schema, a, path))))
        return _some(parts)

    def _text(self, schema: dict, s: Column, path: Column) -> Column:
        parts = []
        if "minLength" in schema:
            parts.append(_fault(path, "minLength", F.length(s) >= schema["minLength"]))
        if "maxLength" in schema:
            parts.append(_fault(path, "maxLength", F.length(s) <= schema["maxLength"]))
        if "pattern" in schema:
            parts.append(_fault(path, "pattern", s.rlike(schema["pattern"])))
        if schema.get("format") in FORMATS:
            parts.append(_fault(path, "format", s.rlike(FORMATS[schema["format"]])))
        return _some(parts)

    def _object(self, schema: dict, m: Column, path: Column) -> Column:
        known = schema.get("properties", {})
        parts = [_fault(F.concat(path, F.lit(f".{name}")), "required", F.map_contains_key(m, name)) for name in schema.get("required", [])]
        parts += [F.when(F.map_contains_key(m, name), self.faults(sub, F.try_element_at(m, F.lit(name)), F.concat(path, F.lit(f".{name}")))) for name, sub in known.items()]
        if schema.get("additionalProperties") is False:
            others = F.array_sort(F.array_except(F.map_keys(m), F.array(*map(F.lit, known)).cast("array<string>")))
            parts.append(F.transform(others, lambda k: F.struct(F.concat(path, F.lit("."), k).alias("path"), F.lit("additionalProperties").alias("rule"))))
        return _some(parts)

    def _array(self, schema: dict, a: Column, path: Column) -> Column:
        parts = []
        if "minItems" in schema:
            parts.append(_fault(path, "minItems", F.size(a) >= schema["minItems"]))
        if "maxItems" in schema:
            parts.append(_fault(path, "maxItems", F.size(a) <= schema["maxItems"]))
        if schema.get("uniqueItems"):
            parts.append(_fault(path, "uniqueItems", F.size(F.array_distinct(F.transform(a, lambda v: F.to_json(v)))) == F.size(a)))
        if "items" in schema:
            each = F.transform(a, lambda v, i: self.faults(schema["items"], v, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
            parts.append(F.flatten(each))
        return _some(parts)


def faults(schema: dict, text: Column) -> Column:
    """(path, rule) structs of all that is wrong with a JSON text, by path, then rule; text that is no JSON fails at ``$`` by ``json``, null gives null."""
    found = bound(F.try_parse_json(text), lambda v: F.when(v.isNull(), _fault(F.lit("$"), "json", F.lit(False)).cast(_FAULTS)).otherwise(Compiler(schema).faults(schema, v, F.lit("$"))))
    return F.when(text.isNotNull(), F.array_sort(found))


def _text(pattern: str) -> dict:
    return {"type": "string", "pattern": pattern}


def _opaque(kind: str) -> dict:
    return _text(f"^{kind}_[A-Za-z0-9_-]{{16,64}}$")


def _closed(**properties: dict) -> dict:
    return {"type": "object", "additionalProperties": False, "required": list(properties), "properties": properties}


_STORED = {"status": {"type": "integer", "minimum": 0, "maximum": 999}, "content_type": {"type": "string", "minLength": 1, "maxLength": 255}, "bytes": {"type": "integer", "minimum": 0}, "digest": {"$ref": "#/$defs/digest"}}
#: What a manifest of a capture holds.
MANIFEST = _closed(
    schema={"const": "archive-manifest.v1"}, format_version={"const": "1.0"}, manifest_id=_opaque("manifest"), archive_id=_opaque("archive"), site_id=_opaque("site"), capture_id=_opaque("capture"),
    captured_at={"type": "string", "format": "date-time"}, entry_page_id=_opaque("page"), pages={"type": "array", "minItems": 1, "items": {"$ref": "#/$defs/page"}}, resources={"type": "array", "items": {"$ref": "#/$defs/resource"}},
) | {
    "$defs": {
        "digest": _text("^sha256:[A-Za-z0-9_-]{43}$"),
        "page": _closed(id=_opaque("page"), source_url={"type": "string", "format": "uri"}, final_url={"type": "string", "format": "uri"}, **_STORED, resource_ids={"type": "array", "items": _opaque("resource"), "uniqueItems": True}),
        "resource": _closed(id=_opaque("resource"), source_url={"type": "string"}, final_url={"type": "string"}, **_STORED),
    }
}
