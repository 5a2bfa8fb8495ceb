"""Readers and writers of corpora and vocabulary tables."""
