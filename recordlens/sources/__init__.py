"""Readers, writers and the staged ingest of public-record feeds."""
