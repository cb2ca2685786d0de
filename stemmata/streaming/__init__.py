"""Incremental runs: what has been done already is left out, in batches or over a stream."""
