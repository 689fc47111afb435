"""Operators for preparing training text: extraction, counting, filtering, matching, packing.

Each module holds one operator with a general interface; ``queries`` holds the thin
registered queries.  Nothing outside this package imports it.
"""
