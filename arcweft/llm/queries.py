"""All queries of the subpackage and their SQL."""

from __future__ import annotations

from arcweft.llm import queries_native, queries_pairs, queries_text, queries_warc

QUERIES = {**queries_text.QUERIES, **queries_pairs.QUERIES, **queries_native.QUERIES, **queries_warc.QUERIES}
SQL = {**queries_native.SQL, **queries_pairs.SQL, **queries_warc.SQL}
