"""Every query of the document engine by name, with its DuckDB equivalent.

The driver's tables stand in for books: a source of documents is a book, a document one of
its spine items in order of doc_id, a line a text node; pages are XHTML documents. Where
the tables have no defect of a kind, the same expression puts one in on both sides.
"""

from __future__ import annotations

from vellum.catalogs import entities, markup, packages, text

QUERIES = text.QUERIES | entities.QUERIES | markup.QUERIES | packages.QUERIES
SQL = text.SQL | entities.SQL | markup.SQL | packages.SQL
