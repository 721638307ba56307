"""Whole queries: the catalogue and the ingestion plan."""
