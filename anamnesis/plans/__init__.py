"""Whole pipelines: recall, retain, consolidation."""
