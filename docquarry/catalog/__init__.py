"""Registered queries: each operator run over the given tables, with its SQL counterpart.

Importing this package registers everything.
"""

from docquarry.catalog.base import ORACLES, QUERIES  # noqa: F401
from docquarry.catalog import (  # noqa: F401
    lexical, chunks, vectors, retrieval, tables, requests, sequences, pages, streams,
)
