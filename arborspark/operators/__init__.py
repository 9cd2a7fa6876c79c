"""Relational operators over the tables of an ontology, profiles and items."""
