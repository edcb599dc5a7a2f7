"""Stored indexes."""
