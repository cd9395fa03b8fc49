"""Registered queries; importing this package fills the registry."""

from . import documents, evaluation, fragments, graph, ingest, retrieval, text  # noqa: F401
