"""Subword vocabularies, corpus segmentation and corpus statistics as Spark DataFrame operators."""
