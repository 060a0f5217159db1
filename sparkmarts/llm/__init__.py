"""Training-data operators: tokenising, packing, deduplication, search and filtering of documents.

Nothing else in the library imports this subpackage. ``queries.py`` holds the registered queries.
"""
