"""Operators of a training-data pipeline, apart from the rest of the library.

Nothing outside this folder imports it.  Each module holds one operator with a
general interface; ``queries`` holds the thin contract queries.  On a cluster
ship the package with ``--py-files`` (Python workers import it by name).
"""
