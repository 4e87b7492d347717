"""WARC records, and a Merkle fixity audit that finds where replicas of archive files differ.

`records` makes a record of each page: header, block and two line ends. `manifest` gives records their place: in the order
of their ids, `PER_FILE` to a file, at offsets that are sums of lengths; it works on slim rows. `placed`, `write`
and `read` are for the files themselves.

The audit works on manifests: (file, ordinal, offset, length, digest) of each record, taken from one replica each. A leaf
hashes a record's digest with its offset range; a node hashes up to `FANOUT` neighbours of the level below, with their
count. `tree` builds all levels of all files, `audit` compares the roots, then only the children of nodes that differ,
down to the leaves. What differs there is a record that one replica has damaged, moved or lost.

Files have `PER_FILE` records, so that no group of a level is large; rows that repeat an id are records of their own, in the
order of their digests; equal rows are equal records, under the same record id. Null ids come last, null pages have empty blocks, null urls an empty address; line ends in urls
are spaces in the header.
"""

from __future__ import annotations

import gzip
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arcweft.llm.common import cut, ranked

#: Records of a file; children of a node of the tree; nodes that differ (16 bytes each) that are sent to every task.
PER_FILE, FANOUT, BROADCAST = 512, 8, 100_000
#: Fixed values of the format.
VERSION, LINE, DATE = "WARC/1.1", "\r\n", "2024-01-01T00:00:00Z"


def records(pages: DataFrame, *keep: str) -> DataFrame:
    """(page_id, url, record, length, digest, and columns to keep): every page as a WARC record, with its bytes and their SHA-256; no exchange."""
    block = F.coalesce("html", F.lit(""))
    hashed = F.sha2(block, 256)
    name = F.md5(F.concat_ws("\n", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), hashed))
    fields = [
        F.lit(VERSION), F.lit("WARC-Type: resource"), F.concat(F.lit("WARC-Record-ID: <urn:md5:"), name, F.lit(">")), F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), F.translate(F.coalesce("url", F.lit("")), "\r\n", "  ")), F.concat(F.lit("WARC-Block-Digest: sha256:"), hashed),
        F.lit("Content-Type: text/html"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    record = F.concat(*[x for f in fields for x in (f, F.lit(LINE))], F.lit(LINE), block, F.lit(LINE + LINE))
    return pages.select("page_id", "url", *keep, record.alias("record")).withColumns({"length": F.octet_length("record").cast("long"), "digest": F.sha2("record", 256)})


def manifest(found: DataFrame) -> DataFrame:
    """`found` (page_id, length, digest and further slim columns) with file, ordinal and offset of each record."""
    placed = ranked(found, ["page_id", "digest"])
    placed = placed.withColumns({"file": F.floor(F.col("rank") / PER_FILE), "ordinal": F.col("rank") % PER_FILE}).drop("rank")
    before = Window.partitionBy("file").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def placed(made: DataFrame, where: DataFrame | None = None) -> DataFrame:
    """(file, ordinal, record) of `records`, for `write`; texts move once, to meet their place.

    `where` is a manifest (page_id, digest, file, ordinal) that is known already; digests are those it was made from.
    """
    where = manifest(made.select("page_id", "length", "digest")) if where is None else where
    same = [F.coalesce("page_id", F.lit(-(2**63)).cast("long")).alias("_id"), F.col("page_id").isNull().alias("_none"), F.col("digest")]
    key = ["_id", "_none", "digest"]
    once = made.select(*same, "record").dropDuplicates(key)  # of records equal byte by byte each place takes the same one
    return where.select(*same, "file", "ordinal").join(once, key).select("file", "ordinal", "record")


def tree(manifest: DataFrame, top: int | None = None) -> DataFrame:
    """(file, level, node, hash): all nodes; leaves are level 0 by ordinal, each file's root is the one node of level `top`.

    `top` defaults to what PER_FILE records need; manifests of longer files need more.
    """
    leaf = F.sha2(F.concat_ws(":", "digest", F.col("offset").cast("string"), F.col("length").cast("string")), 256)
    level = manifest.select("file", F.lit(0).alias("level"), F.col("ordinal").alias("node"), leaf.alias("hash"))
    out = level
    for k in range(1, (levels() if top is None else top) + 1):
        children = F.array_sort(F.collect_list(F.struct("node", "hash")))
        level = level.groupBy("file", F.floor(F.col("node") / FANOUT).alias("_up")).agg(children.alias("_of"))
        named = F.transform("_of", lambda c: F.concat_ws("=", c["node"].cast("string"), c["hash"]))
        level = level.select("file", F.lit(k).alias("level"), F.col("_up").alias("node"), F.sha2(F.array_join(named, ";"), 256).alias("hash"))
        out = out.unionByName(level)
    return out


def levels(records: int = PER_FILE) -> int:
    """Levels above the leaves that a file of so many records needs."""
    n = 0
    while records > 1:
        records = -(-records // FANOUT)
        n += 1
    return n


def audit(one: DataFrame, other: DataFrame, top: int | None = None) -> DataFrame:
    """(file, ordinal) of the leaves that differ between two trees, found from the roots down.

    Each level joins only the children of nodes that differ on the level above. Up to `BROADCAST` such nodes go to where the level
    lies, so that of equal subtrees nothing is moved or compared; of more, both sides are dealt out. Files, nodes and records that one side lacks differ.
    """
    top = levels() if top is None else top
    at = lambda t, k, name: t.filter(F.col("level") == k).select("file", "node", F.col("hash").alias(name))
    wrong = None
    for k in range(top, -1, -1):
        a, b = at(one, k, "_a"), at(other, k, "_b")
        if wrong is not None:
            wrong = cut(wrong)
            parents = wrong.select("file", F.explode(F.sequence(F.col("node") * FANOUT, F.col("node") * FANOUT + FANOUT - 1)).alias("node"))
            if wrong.count() <= BROADCAST:
                parents = F.broadcast(parents)
            a, b = a.join(parents, ["file", "node"], "left_semi"), b.join(parents, ["file", "node"], "left_semi")
        wrong = a.join(b, ["file", "node"], "full").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select("file", "node")
    return wrong.withColumnRenamed("node", "ordinal")


# --- files ---


def write(records: DataFrame, folder: str, compress: bool = False) -> DataFrame:
    """Bytes of each file, (path, content): `folder`/`file`.warc or .warc.gz, one gzip member a record.

    The caller stores them by a sink of its choice; `records` has file, ordinal and record. Files have a bounded number
    of records, so a file is one row.
    """

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [r.encode() for r in rows.sort_values("ordinal")["record"]]
        content = b"".join(gzip.compress(p, mtime=0) for p in parts) if compress else b"".join(parts)
        return pd.DataFrame({"path": [f"{folder}/{int(rows['file'].iloc[0]):08d}.warc{'.gz' if compress else ''}"], "content": [content]})

    return records.select("file", "ordinal", "record").groupBy("file").applyInPandas(joined, "path string, content binary")


_HEAD = re.compile(rb"WARC/\d\.\d\r\n(?:[^\r\n]+\r\n)*\r\n")
_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d+)")
_URI = re.compile(rb"(?im)^warc-target-uri:[ \t]*<?([^\r\n>]*)")
_TYPE = re.compile(rb"(?im)^warc-type:[ \t]*([^\r\n]*)")


_NEXT = re.compile(rb"(?<=[\r\n])" + _HEAD.pattern)
_MEMBER = re.compile(rb"\x1f\x8b\x08")


def _unpacked(content: bytes) -> Iterator[bytes]:
    """What the gzip members of a file hold; of a damaged one what comes out of it, and on from the next member that is whole."""
    at = 0
    while at < len(content):
        member = zlib.decompressobj(31)
        out, rest = [], at
        try:
            while rest < len(content) and not member.eof:
                out.append(member.decompress(content[rest : rest + 65536]))
                rest += 65536
        except zlib.error:
            pass
        if out:
            yield b"".join(out)
        if member.eof:
            at = min(rest, len(content)) - len(member.unused_data)
        else:
            at += 1
        found = _MEMBER.search(content, at)  # the next one, past padding and past what is damaged
        at = found.start() if found else len(content)


def parse(content: bytes) -> list[dict]:
    """Records of one file: ordinal, offset, length, type, url, block, digest of all its bytes.

    Where no record begins, what follows up to the next head of one is passed over. A length that leads neither to the
    line ends of a record nor to the end of the file is not believed if a head comes later: the record ends there.
    """
    import hashlib

    if content[:2] == b"\x1f\x8b":
        content = b"".join(_unpacked(content))
    out, at = [], 0
    while at < len(content):
        m = _HEAD.match(content, at)
        if not m:
            found = _NEXT.search(content, at + 1)
            if not found:
                break
            at = found.start()
            continue
        size = _LENGTH.search(m[0])
        stop = m.end() + int(size[1]) if size else m.end()
        end = stop + 4 if content[stop : stop + 4] == b"\r\n\r\n" else stop
        if end == stop != len(content) and (found := _NEXT.search(content, m.end())):
            stop = end = found.start()
        stop, end = min(stop, len(content)), min(end, len(content))
        uri, kind = _URI.search(m[0]), _TYPE.search(m[0])
        out.append({"ordinal": len(out), "offset": at, "length": end - at, "type": kind[1].decode("utf-8", "replace") if kind else "", "url": uri[1].decode("utf-8", "replace") if uri else "", "block": content[m.end() : stop], "digest": hashlib.sha256(content[at:end]).hexdigest()})
        at = end
    return out


def parsed(files: DataFrame) -> DataFrame:
    """(path, ordinal, offset, length, type, url, block, digest) of all records of files (path, content), a slice of a file at a time."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                found = parse(bytes(content))
                for at in range(0, len(found), 64):
                    yield pd.DataFrame(found[at : at + 64]).assign(path=name)[["path", "ordinal", "offset", "length", "type", "url", "block", "digest"]]

    return files.select("path", "content").mapInPandas(rows, "path string, ordinal long, offset long, length long, type string, url string, block binary, digest string")


def read(spark: SparkSession, path: str) -> DataFrame:
    """What `parsed` finds in WARC files, plain or gzip. A file is one row, so that files have to be of bounded size, as those of `write` are."""
    return parsed(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))
