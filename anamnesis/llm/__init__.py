"""Operators of a training-data pipeline: cleaning, deduplication, mixing and tokenisation of document tables."""
