"""Query of the archive operator: op3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweft.llm import warc
from arcweft.llm.common import cut, table


def op3_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, and whether an audit against a replica finds it damaged.

    The replica is a set of WARC files with planted damage, whose manifest is read from their bytes: in records whose id has an md5
    that starts with 0 modulo 50 (16 bits), the last character of the block is another; for 1, the last byte of the record is
    lost. Both may move what follows in the file (`differs`, not `damaged`).
    """
    kind = F.conv(F.substring(F.md5(F.col("page_id").cast("string")), 1, 4), 16, 10).cast("int") % 50
    other = F.expr("concat(left(record, length(record) - 5), '#', right(record, 4))")
    hurt = F.when((kind == 0) & F.col("html").isNotNull() & (F.col("html") != ""), other).when(kind == 1, F.expr("left(record, length(record) - 1)")).otherwise(F.col("record"))
    made = warc.records(table(spark, sf_dir, "pages").select("page_id", "url", "html"), "html")
    mine = cut(warc.manifest(made.select("page_id", "length", "digest")))
    files = warc.write(warc.placed(made.withColumn("record", hurt), mine), "replica")
    theirs = warc.parsed(files).select(F.regexp_extract("path", r"(\d+)\.warc", 1).cast("long").alias("file"), "ordinal", "offset", "length", F.col("digest").alias("_digest"))
    theirs = cut(theirs)
    found = warc.audit(cut(warc.tree(mine)), cut(warc.tree(theirs.withColumnRenamed("_digest", "digest")))).withColumn("_found", F.lit(True))
    out = mine.join(found, ["file", "ordinal"], "left").join(theirs.select("file", "ordinal", "_digest"), ["file", "ordinal"], "left")
    differs = F.col("_found").isNotNull()
    return out.select("page_id", "file", "ordinal", "offset", "length", "digest", differs.alias("differs"), (differs & ~F.col("digest").eqNullSafe(F.col("_digest"))).alias("damaged"))


OP3_SQL = r"""
WITH t AS (SELECT page_id, coalesce(html, '') AS block, 'WARC/1.1' || e'\r\n' || 'WARC-Type: resource' || e'\r\n'
  || 'WARC-Record-ID: <urn:md5:' || md5(coalesce(page_id::VARCHAR, '') || chr(10) || coalesce(url, '') || chr(10) || sha256(coalesce(html, ''))) || '>' || e'\r\n'
  || 'WARC-Date: 2024-01-01T00:00:00Z' || e'\r\n' || 'WARC-Target-URI: ' || translate(coalesce(url, ''), e'\r\n', '  ') || e'\r\n' || 'WARC-Block-Digest: sha256:' || sha256(coalesce(html, '')) || e'\r\n'
  || 'Content-Type: text/html' || e'\r\n' || 'Content-Length: ' || octet_length(encode(coalesce(html, '')))::VARCHAR || e'\r\n\r\n' || coalesce(html, '') || e'\r\n\r\n' AS record FROM pages),
k AS (SELECT *, coalesce(('0x' || substr(md5(page_id::VARCHAR), 1, 4))::INT % 50, 2) AS kind FROM t),
h AS (SELECT page_id, octet_length(encode(record))::BIGINT AS length, sha256(record) AS digest,
  CASE WHEN kind = 0 AND block <> '' THEN substr(record, 1, length(record) - 5) || '#' || substr(record, length(record) - 3) WHEN kind = 1 THEN substr(record, 1, length(record) - 1) ELSE record END AS hurt FROM k),
p AS (SELECT page_id, length, digest, sha256(hurt) <> digest AS damaged, length - octet_length(encode(hurt)) AS lost, row_number() OVER (ORDER BY page_id NULLS LAST, digest) - 1 AS rank FROM h)
SELECT page_id, rank // 512 AS file, rank % 512 AS ordinal,
       coalesce(sum(length) OVER before, 0)::BIGINT AS "offset", length, digest, damaged OR coalesce(sum(lost) OVER before, 0) > 0 AS differs, damaged FROM p
WINDOW before AS (PARTITION BY rank // 512 ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""

SQL = {"op3_warc_fixity": OP3_SQL}
QUERIES = {"op3_warc_fixity": op3_warc_fixity}
