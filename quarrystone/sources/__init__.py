"""Readers and writers: the archive's tables, capture packages, manifests, object stores, web-archive files."""
