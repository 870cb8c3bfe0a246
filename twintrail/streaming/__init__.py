"""Incremental work: only what has not been processed yet."""
