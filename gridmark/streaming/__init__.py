"""Continuous ingest of annotation documents."""
