"""Operators for preparing training corpora.

Nothing else in the library imports this subpackage.  Every module holds one
operator (or one shared helper); `queries.py` binds them to the driver tables.
"""
