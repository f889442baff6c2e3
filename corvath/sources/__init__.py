"""Readers, format parsers and sinks."""
