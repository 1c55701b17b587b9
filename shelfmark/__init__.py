"""Corpus organiser: DataFrame operators for large collections of text, label and vector items."""
