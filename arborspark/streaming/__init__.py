"""Observed frequencies of terms over a stream of annotations."""
