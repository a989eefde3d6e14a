"""Readers, normalisation and table sinks."""
