"""Importing this module registers every query."""

from . import blend, drift, ingest, metrics, models, plans, quality, series, streams, text, tfidf, vectors  # noqa: F401
