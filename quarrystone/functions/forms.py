"""Multipart forms: bodies of bytes cut at their boundary, as an Arrow-batched UDF. Fields that are urlencoded are ``urls.form_fields``."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField, StructType

#: Fixed value: fields of a form at most.
MOST = 100
#: Forms whose fields a worker holds at once.
ROWS = 64
_PARAMETER = re.compile(r""";\s*([A-Za-z0-9!#$&^_.+-]+\*?)\s*=\s*("(?:\\.|[^"\\])*"|[^;"\s]*)""")
FIELD = StructType([StructField(n, StringType()) for n in ("name", "filename", "content_type", "value")] + [StructField("body", BinaryType()), StructField("problem", StringType())])


def header(value: str) -> tuple[str, dict[str, str]]:
    """A header's first word and its parameters, their quotes and escapes resolved."""
    found = {m[1].lower(): re.sub(r"\\(.)", r"\1", m[2][1:-1]) if m[2].startswith('"') else m[2] for m in _PARAMETER.finditer(value)}
    return value.partition(";")[0].strip().lower(), found


def _parts(boundary: bytes, body: bytes) -> tuple[list[bytes], bool]:
    """What lies between the boundaries, and whether the last of them closes the body."""
    found, at = [], None
    for m in re.finditer(rb"(?:^|\r\n|\n)--" + re.escape(boundary) + rb"(--)?[ \t]*(?=\r\n|\n|\Z)", body):
        if at is not None:
            found.append(body[at : m.start()])
        if m[1]:
            return found, True
        at = m.end()
    if at is not None:
        found.append(body[at:])
    return found, False


def _field(part: bytes) -> dict | None:
    """A part as a field; None for parts that are no form data or have no name."""
    m = re.match(rb"(?:\r\n|\n)((?:[^\r\n]+(?:\r\n|\n))*)(?:\r\n|\n)", part)
    if not m:
        return {"name": None, "problem": "headers without an end"}
    lines = re.sub(rb"\r?\n[ \t]+", b" ", m[1]).decode("utf-8", "replace").splitlines()
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    kind, about = header(headers.get("content-disposition", ""))
    if kind != "form-data" or not about.get("name"):
        return None
    content, charset = header(headers.get("content-type", "text/plain"))
    body, filename = part[m.end() :], about.get("filename")
    out = {"name": about["name"], "filename": filename, "content_type": content, "value": None, "body": body, "problem": None}
    if filename is None:
        try:
            out |= {"value": body.decode(charset.get("charset", "utf-8")), "body": None}
        except (LookupError, ValueError):
            out["problem"] = "text that isn't of its charset"
    return out


def fields_of(content_type: str | None, body: bytes | None) -> list[dict]:
    """The fields of a form in the order of their names' first place; of a repeated name the last one counts.

    A body without a boundary is one problem, as is one that isn't closed; a part whose headers don't end is a problem of its own. Files keep their bytes, other
    fields are text. Beyond MOST names nothing is taken.
    """
    kind, about = header(content_type or "")
    boundary = about.get("boundary", "")
    if kind != "multipart/form-data" or not boundary:
        return [{"problem": "no multipart form"}]
    parts, closed = _parts(boundary.encode("utf-8"), body or b"")
    fields: dict[str, dict] = {}
    problems = [] if closed else [{"problem": "not closed" if parts else "no boundary in the body"}]
    for part in parts:
        f = _field(part)
        if f and f["problem"] and f["name"] is None:
            problems.append(f)
        elif f and (f["name"] in fields or len(fields) < MOST):
            fields[f["name"]] = f
    return [*fields.values(), *problems]


def with_fields(rows: DataFrame, content_type: str = "content_type", body: str = "body", name: str = "fields") -> DataFrame:
    """``rows`` with ``fields_of`` each body in the place of its content type and body; a worker holds the fields of no more than ROWS forms at once."""
    others = [f for f in rows.schema.fields if f.name not in (content_type, body)]
    kind = to_arrow_type(ArrayType(FIELD))
    empty = dict.fromkeys(FIELD.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                piece = b.slice(at, ROWS)
                pairs = zip(piece.column(content_type).to_pylist(), piece.column(body).to_pylist(), strict=True)
                found = pa.array([None if x is None else [empty | f for f in fields_of(t, x)] for t, x in pairs], kind)
                yield pa.RecordBatch.from_arrays([*(piece.column(f.name) for f in others), found], [*(f.name for f in others), name])

    return rows.mapInArrow(run, StructType([*others, StructField(name, ArrayType(FIELD))]))


@F.pandas_udf(ArrayType(FIELD))
def multipart(content_types: pd.Series, bodies: pd.Series) -> pd.Series:
    """``fields_of`` each body; null of a null."""
    empty = dict.fromkeys(FIELD.fieldNames())
    return pd.Series([None if b is None else [empty | f for f in fields_of(t, bytes(b))] for t, b in zip(content_types, bodies, strict=True)])
