"""Counts over arriving text: the same aggregates on unbounded tables."""
