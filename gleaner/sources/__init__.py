"""Readers, the source registry, and sinks."""
