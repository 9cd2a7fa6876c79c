"""Whole plans: the order in which operators are applied to one ontology and its profiles."""
