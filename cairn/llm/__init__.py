"""Training-data operators: filtering, deduplication, scoring, packing and export of documents.

Nothing outside this subpackage imports it.
"""
