"""Operators on tables of comments, documents and predictions."""
