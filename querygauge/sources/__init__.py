"""Readers, schema catalogs and sinks."""
