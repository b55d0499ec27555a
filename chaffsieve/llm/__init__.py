"""Training-data operators: tokenisation, filtering, deduplication and formatting over whole corpora.

Nothing else in the library imports this subpackage.
"""
