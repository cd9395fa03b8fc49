"""Ingestion of files that keep coming."""
