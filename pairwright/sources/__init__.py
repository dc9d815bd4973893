"""Readers for pair corpora and the stored tables of the curation loop."""
