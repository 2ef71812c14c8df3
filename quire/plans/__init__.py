"""Whole-corpus plans built from the operators."""
