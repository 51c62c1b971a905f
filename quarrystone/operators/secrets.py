"""Flags of secret-like content by class, for a repository check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Classes of content that must not be published, and folders and endings that must not either.
CLASSES = {
    "private_key": "-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "access_key": r"\bAKIA[0-9A-Z]{16}\b",
    "hosting_token": r"\bgh[pousr]_[A-Za-z0-9]{30,}\b",
    "bearer": r"(?i)\bbearer\s+[a-z0-9._-]{24,}",
    "assigned_hex": r"(?i)\b(?:token|secret|password|api_?key)\s*[:=]\s*[\x22\x27]?[0-9a-f]{32,}",
}
FOLDERS = ("data", "snapshots", "backups", "exports", ".venv", "node_modules", "__pycache__", "logs", "tmp")
ENDINGS = (".db", ".sqlite", ".sqlite3", ".pem", ".key", ".p12", ".env", ".log", ".bak", ".tar.gz", ".zip", ".warc", ".pyc", ".pid", ".sock")


def classes(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with a flag for each class."""
    return rows.withColumns({n: F.col(column).rlike(p) for n, p in CLASSES.items()})


def forbidden_path(path):
    """Whether a path lies in a folder or has an ending that must not be published."""
    parts = F.split(path, "/")
    ending = F.lit(False)
    for e in ENDINGS:
        ending = ending | F.lower(path).endswith(e)
    return F.arrays_overlap(parts, F.array(*map(F.lit, FOLDERS))) | ending
