"""A project's files as a DataFrame: (path, is_dir, content), paths relative to the project's folder."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcweft.sources.ignore import always_ignored, ignored, rules_of

#: Extensions of files that are parsed.
EXTENSIONS = (".ts", ".tsx")
FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("is_dir", T.BooleanType()), T.StructField("content", T.StringType())])


def walk(folder: str) -> Iterator[tuple[str, bool]]:
    """Relative paths below a local folder with whether they are folders; links are not followed, but a link to a folder counts as one.

    Folders with always-ignored names are not entered. What can't be listed is left out.
    """
    from arcweft.sources.ignore import ALWAYS

    stack = [""]
    while stack:
        below = stack.pop()
        try:
            entries = sorted(os.scandir(os.path.join(folder, below)), key=lambda e: e.name)
        except OSError:
            continue
        for e in entries:
            path = f"{below}/{e.name}" if below else e.name
            is_dir = os.path.isdir(e.path)
            yield path, is_dir
            if e.is_dir(follow_symlinks=False) and e.name not in ALWAYS:
                stack.append(path)


def local_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder that the driver sees. Text that is not UTF-8 has null content."""

    def text(path: str, is_dir: bool) -> str | None:
        if is_dir or not path.endswith((*EXTENSIONS, ".gitignore")):
            return None
        try:
            with open(os.path.join(folder, path), encoding="utf-8", newline="") as f:
                return f.read()
        except (OSError, UnicodeDecodeError):
            return None

    return spark.createDataFrame([(p, d, text(p, d)) for p, d in walk(folder)], FILES)


def stored_files(spark: SparkSession, folder: str) -> DataFrame:
    """The same from any store that Spark reads, distributed: executors read the sources, folders come from the paths of files."""
    from urllib.parse import unquote, urlparse

    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    base = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(top).toString().rstrip("/") + "/"
    path = F.expr(f"substring(path, length('{base}') + 1)")
    content = F.expr("if(is_valid_utf8(content), string(content), null)")
    texts = reader.option("pathGlobFilter", "*.{ts,tsx}").load(folder).select(path.alias("path"), content.alias("content"), F.lit(True).alias("_read"))
    # the reader leaves out empty files; the listing, which the driver holds anyway, has them
    below = len(urlparse(base).path)
    names = [unquote(urlparse(u).path)[below:] for u in reader.option("pathGlobFilter", "*").load(folder).inputFiles()]
    listed = spark.createDataFrame([(n,) for n in names], "path string")
    text = F.when(F.col("_read").isNull() & F.col("path").rlike(r"\.tsx?$"), "").otherwise(F.col("content"))
    files = listed.join(texts, "path", "left").select("path", F.lit(False).alias("is_dir"), text.alias("content"))
    files = files.unionByName(_hidden(spark, top, below, max((n.count("/") for n in names), default=0)))
    parts = F.split("path", "/")
    folders = files.filter(F.size(parts) > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("path")).distinct()
    return files.unionByName(folders.select("path", F.lit(True).alias("is_dir"), F.lit(None).cast("string").alias("content")))


def _hidden(spark: SparkSession, top, below: int, depth: int) -> DataFrame:  # noqa: ANN001
    """Ignore files, which Spark's listing leaves out as hidden; there are few, so that the driver reads them."""
    jvm = spark.sparkContext._jvm
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = []
    for k in range(depth + 1):
        for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(top, "*/" * k + ".gitignore")) or []:
            stream = fs.open(status.getPath())
            try:
                text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            rows.append((status.getPath().toUri().getPath()[below:], False, text))
    return spark.createDataFrame(rows, FILES)


def modules_of(files: DataFrame, root_name: str = "") -> DataFrame:
    """Files to parse, (path, content), in which no ignored path is left.

    A project folder that itself bears an always-ignored name has none. Order: that of `split(path, '/')`, a walk
    through sorted names. Unreadable files (null content) are left in; the parser drops them.
    """
    from arcweft.sources.ignore import ALWAYS

    own = files.filter(~F.col("is_dir") & F.col("path").rlike(r"\.tsx?$"))
    if root_name in ALWAYS:
        return own.filter(F.lit(False)).select("path", "content")
    kept = own.filter(~always_ignored(F.col("path")))
    return kept.join(ignored(kept.select("path", "is_dir"), rules_of(files)), "path", "left_anti").select("path", "content")
