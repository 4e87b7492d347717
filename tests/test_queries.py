"""Queries over fixed cases against their SQL, on the smallest of the bundled tables."""

import os

import duckdb
import pytest

from arcweft import queries_cases

FOLDER = "/root/testdata/sf0.001"


def test_every_case_has_sql():
    assert set(queries_cases.QUERIES) - set(queries_cases.SQL) == {"report_transitive"}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no bundled tables")
@pytest.mark.parametrize("name", ["rule_spellings", "rule_most_spellings", "pattern_agreement", "casing_decodings", "pattern_errors", "near_names", "rulebook_errors", "report_lines", "parse_edges", "ignored_classes", "ignored_escapes", "project_stored", "project_fix"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("customer", "nation", "region", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    rows = queries_cases.QUERIES[name](spark, FOLDER)
    found = con.execute(queries_cases.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(rows.columns)
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in rows.collect()))) == sorted(map(repr, found.fetchall()))
