"""Readers and writers: ontology text and JSON, tab-separated profiles and texts, tables."""
