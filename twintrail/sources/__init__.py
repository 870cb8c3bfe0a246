"""Readers, sinks and the views on the star-schema tables."""
