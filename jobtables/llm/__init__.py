"""Operators for preparing training data (documents, pages, embeddings).

Nothing else in the library imports this subpackage.
"""
