"""Incremental versions of the evaluation and training summaries."""
