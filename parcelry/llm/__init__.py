"""Operators of a training-data pipeline: cleaning, deduplication, scoring, mixing and encoding of documents."""
