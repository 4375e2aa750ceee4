"""Operators for training-data corpora, with their registered queries."""
