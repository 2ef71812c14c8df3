"""Readers and writers of manuscript corpora."""
