"""Operators that prepare a text corpus for model training."""
