"""Operators for preparing training data, on the tables of documents, pages and conversations."""
