"""Part of the corpus organiser."""
