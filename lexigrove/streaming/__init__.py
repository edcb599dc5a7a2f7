"""Ingestion from streams."""
