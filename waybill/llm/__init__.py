"""Operators for preparing training text: filtering, deduplication, token counts, packing and vector search.

Nothing outside this package imports it.  Each module holds one operator with its own general interface; ``queries``
holds the thin registered queries over the standard tables.
"""
