import gzip
import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from arcweft.llm import queries_warc, warc

PAGES = [(3, "http://x/é", "<p>é</p>"), (1, "http://x/1", "a\r\n\r\nWARC/1.1\r\nb"), (2, None, None), (None, "u", "null id"), (1, "http://x/1", "a\r\n\r\nWARC/1.1\r\nb"), (5, "v\r\nw", "x" * 100_000)]
SCHEMA = "page_id long, url string, html string"


@pytest.mark.parametrize("compress", [False, True])
def test_files_round_trip(spark, tmp_path, compress, monkeypatch):
    monkeypatch.setattr(warc, "PER_FILE", 4)
    made = warc.records(spark.createDataFrame(PAGES, SCHEMA))
    for row in warc.write(warc.placed(made), str(tmp_path), compress).collect():
        with open(row.path, "wb") as f:
            f.write(row.content)
    got = warc.read(spark, str(tmp_path)).orderBy("path", "ordinal").collect()
    where = warc.manifest(made.select("page_id", "length", "digest")).orderBy("file", "ordinal").collect()
    assert [(r.ordinal, r.offset, r.length, r.digest) for r in got] == [(r.ordinal, r.offset, r.length, r.digest) for r in where]
    assert sorted((r.url, bytes(r.block).decode()) for r in got) == sorted(((u or "").replace("\r\n", "  "), h or "") for _, u, h in PAGES)
    assert {r.type for r in got} == {"resource"} and [r.page_id for r in where] == [1, 1, 2, 3, 5, None]


def test_parse_stops_at_what_is_no_record():
    assert warc.parse(b"") == [] and warc.parse(b"garbage") == []
    good = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    assert [r["block"] for r in warc.parse(good + b"junk")] == [b"hi"]


def test_damage_stays_in_its_record():
    make = lambda k: f"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 7\r\n\r\nblock {k}\r\n\r\n".encode()
    parts = [make(k) for k in range(5)]
    whole = [r["digest"] for r in warc.parse(b"".join(parts))]
    for old, new in ((b"WARC/1.1", b"XARC/1.1"), (b": 7\r\n", b": 9\r\n"), (b": 7\r\n", b": 900\r\n"), (b": 7\r\n", b": x\r\n"), (b"\r\n\r\n", b"\r\r\r\n")):
        bad = [*parts[:2], parts[2].replace(old, new, 1), *parts[3:]]
        got = [r["digest"] for r in warc.parse(b"".join(bad))]
        assert [d for d in got if d in whole] == whole[:2] + whole[3:]
    packed = [gzip.compress(p, mtime=0) for p in parts]
    for at in (0, 12, len(packed[2]) - 6):
        hurt = bytearray(packed[2])
        hurt[at] ^= 0xFF
        got = [r["digest"] for r in warc.parse(b"".join([*packed[:2], bytes(hurt), *packed[3:]]))]
        assert set(whole[:2] + whole[3:]) <= set(got)


def manifest(spark, rows):
    return spark.createDataFrame(rows, "file long, ordinal long, offset long, length long, digest string")


def test_audit_finds_exactly_what_differs(spark):
    rows = [(f, k, 100 * k, 100, hashlib.md5(f"{f}/{k}".encode()).hexdigest()) for f in range(4) for k in range(150)]
    other = {(r[0], r[1]): list(r) for r in rows}
    other[0, 77][4] = "damaged"
    other[2, 0][2] = 1
    del other[2, 149]
    extra = {k: v for k, v in other.items() if k[0] != 3} | {(9, 0): [9, 0, 0, 5, "new"]}
    one, two = warc.tree(manifest(spark, rows)), warc.tree(manifest(spark, [tuple(v) for v in extra.values()]))
    got = {(r.file, r.ordinal) for r in warc.audit(one, two).collect()}
    assert got == {(0, 77), (2, 0), (2, 149), (9, 0)} | {(3, k) for k in range(150)}
    assert warc.audit(one, one).count() == 0
    assert one.filter(F.col("level") == warc.levels()).count() == 4 and warc.levels(512) == 3 and warc.levels(1) == 0
    nothing = warc.tree(manifest(spark, []))
    assert warc.audit(nothing, nothing).count() == 0


def test_query_against_sql(spark, tmp_path):
    pages = [(*p, "x", 1) for p in PAGES] + [(100 + i, f"u{i}", f"page {i}", "x", 1) for i in range(1200)]
    spark.createDataFrame(pages, SCHEMA + ", record string, offset int").write.parquet(str(tmp_path / "pages.parquet"))
    got = queries_warc.op3_warc_fixity(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view pages as select page_id, url, html from '{tmp_path}/pages.parquet/*.parquet'")
    columns = sorted(got.columns)
    want = con.execute(f'select {", ".join(chr(34) + c + chr(34) for c in columns)} from ({queries_warc.OP3_SQL}) q').fetchall()
    assert sorted(map(repr, want)) == sorted(map(repr, map(tuple, got.select(*columns).collect())))
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none/pages.parquet"))
    assert queries_warc.op3_warc_fixity(spark, str(tmp_path / "none")).count() == 0
