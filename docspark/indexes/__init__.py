"""Stored indexes behind the search operators."""
