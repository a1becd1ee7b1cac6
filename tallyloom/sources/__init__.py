"""Ingestion jobs, one per harness."""
