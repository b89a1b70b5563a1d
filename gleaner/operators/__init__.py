"""Relational operators over listings, corpora and predictions."""
