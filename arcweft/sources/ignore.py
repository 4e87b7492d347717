"""Ignore files: which paths of a tree are left out.

Each line of an ignore file becomes one row: the folder it speaks for, its place, and a regular expression over the path
below that folder (or over the last name alone, where the line has no slash). Whether a path is ignored is then a join of its
ancestors with the rows that speak for folders above it, and the last row that matches decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweft.plans.patterns import quote

#: Names that are always ignored, wherever they stand.
ALWAYS = (
    "node_modules", ".git", "dist", ".next", "next-env.d.ts", ".next-env.d.ts", "build", "out", ".output", "storybook-static", "coverage",
    ".direnv", ".devenv", ".turbo", ".cache", ".parcel-cache", ".yarn", ".svelte-kit", ".nuxt", ".astro", ".vercel", ".wrangler",
)
#: POSIX classes by the Unicode properties that they stand for, in Java's terms.
POSIX = {
    "alnum": r"[\p{IsAlphabetic}\p{N}]", "alpha": r"[\p{IsAlphabetic}]", "blank": r"[\t\p{Zs}]", "cntrl": r"[\p{Cc}]", "digit": "[0-9]", "graph": r"[^\p{Cc}\p{IsWhite_Space}]",
    "lower": r"[\p{IsLowercase}]", "print": r"[^\p{Cc}]", "punct": r"[^\p{IsAlphabetic}\p{N}\p{IsWhite_Space}\p{Cc}]", "space": r"[\p{IsWhite_Space}]", "upper": r"[\p{IsUppercase}]", "xdigit": "[0-9A-Fa-f]",
}


@dataclass(frozen=True)
class IgnoreLine:
    """One line: `regex` is matched as a whole, against the path below the file's folder or against the last name."""

    regex: str
    negated: bool
    dir_only: bool
    anchored: bool


def parse_line(raw: str) -> IgnoreLine | None:
    """What a line says; None for blank lines and comments."""
    line = raw.rstrip("\r")
    while line.endswith(" ") and (len(line) - 1 - len(line[:-1].rstrip("\\"))) % 2 == 0:
        line = line[:-1]
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    body = line[negated:]
    dir_only = body.endswith("/")
    body = body[:-1] if dir_only else body
    if not body:
        return None
    return IgnoreLine(_path_regex(body.removeprefix("/").split("/")), negated, dir_only, "/" in body)


def _path_regex(segments: list[str]) -> str:
    """Segments joined by slashes; `**` is any number of them, but at least one in the last place."""
    out, last = [], len(segments) - 1
    for i, s in enumerate(segments):
        if s == "**":
            out.append("(?:[^/]+/)*[^/]+" if i == last else "(?:[^/]+/)*")
        else:
            out.append(_segment_regex(s) + ("" if i == last else "/"))
    return r"\A" + "".join(out) + r"\z"


def _segment_regex(segment: str) -> str:
    pieces = list(_tokens(segment))
    return quote(segment) if None in pieces else "".join(pieces)


def _tokens(s: str) -> Iterator[str | None]:
    """Expressions of a segment's tokens; None where it can't be read, so that all of it is literal."""
    i = 0
    while i < len(s):
        if s[i] == "*":
            yield "[^/]*"
        elif s[i] == "?":
            yield "[^/]"
        elif s[i] == "\\":
            i += 1
            yield quote(s[i]) if i < len(s) else None
        elif s[i] == "[" and (found := _class(s, i)):
            yield found[0]
            i = found[1] - 1
        else:
            yield quote(s[i])
        i += 1


_POSIX_NAME = re.compile(r"\[:([a-z]+):\]")


def _class(s: str, i: int) -> tuple[str, int] | None:
    """The character class that begins at i and where it ends; None if it is none."""
    i += 1
    negated = s[i : i + 1] in ("!", "^")
    i += negated
    members: list[str] = []
    if s[i : i + 1] == "]":
        members.append(r"[\]]")
        i += 1

    def char(at: int) -> tuple[str, int] | None:
        if s[at : at + 1] == "\\":
            return (s[at + 1], at + 2) if at + 1 < len(s) else None
        return (s[at], at + 1) if at < len(s) and s[at] != "]" else None

    while i < len(s) and s[i] != "]":
        if (m := _POSIX_NAME.match(s, i)) and m[1] in POSIX:
            members.append(POSIX[m[1]])
            i = m.end()
            continue
        low = char(i)
        if low is None:
            return None
        high = char(low[1] + 1) if s[low[1] : low[1] + 1] == "-" else None
        if high:
            if low[0] <= high[0]:
                members.append(f"[{quote(low[0])}-{quote(high[0])}]")
            i = high[1]
        else:
            members.append(f"[{quote(low[0])}]")
            i = low[1]
    if i >= len(s):
        return None
    if not members:
        return ("[^/]" if negated else r"(?!)"), i + 1
    return f"(?!/)(?{'!' if negated else '='}[{''.join(members)}])[\\s\\S]", i + 1


def rules_of(files: DataFrame, name: str = ".gitignore") -> DataFrame:
    """Rows (scope, depth, line_no, regex, negated, dir_only, anchored) from ignore files among `files` (path, content).

    Paths are relative to the project's folder, `scope` is the folder of the ignore file ("" for the top). Ignore
    files below an always-ignored name have no say. Lines are parsed in Arrow batches; there are few of them.
    """
    from collections.abc import Iterator as It

    import pandas as pd

    def lines(batches: It[pd.DataFrame]) -> It[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                scope = path.rpartition("/")[0]
                for n, raw in enumerate((content or "").split("\n")):
                    if line := parse_line(raw):
                        rows.append((scope, scope.count("/") + 1 if scope else 0, n, line.regex, line.negated, line.dir_only, line.anchored))
            yield pd.DataFrame(rows, columns=["scope", "depth", "line_no", "regex", "negated", "dir_only", "anchored"])

    own = files.filter((F.element_at(F.split("path", "/"), -1) == name) & ~always_ignored(F.col("path")))
    return own.select("path", "content").mapInPandas(lines, "scope string, depth int, line_no int, regex string, negated boolean, dir_only boolean, anchored boolean")


def rules_from(spark: SparkSession, scopes: dict[str, str]) -> DataFrame:
    """The same rows from {folder: text of its ignore file}."""
    rows = [(f"{scope}/.gitignore" if scope else ".gitignore", text) for scope, text in scopes.items()]
    return rules_of(spark.createDataFrame(rows, "path string, content string"))


def always_ignored(path: Column) -> Column:
    """Whether a name on the path is one of ALWAYS."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, ALWAYS)))


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """The ignored ones of `paths` (path, is_dir), as (path).

    An entry is ignored if it or a folder above it bears an always-ignored name, or if the last rule that matches it is
    not negated; deeper ignore files come after those above them. Rules are joined on the folder they speak for, so that a
    path only meets those of its own ancestors.
    """
    parts = F.split("path", "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("entry"), ((i < F.size(parts)) | F.col("is_dir")).alias("entry_dir")))
    entries = paths.select("path", "is_dir", F.inline(steps)).select("path", "entry", "entry_dir").distinct()
    above = F.split("entry", "/")
    scopes = F.transform(F.sequence(F.lit(0), F.size(above) - 1), lambda i: F.array_join(F.slice(above, F.lit(1), i), "/"))
    each = entries.select("entry", "entry_dir").distinct().withColumn("scope", F.explode(scopes)).join(rules, "scope")
    below = F.when(F.col("scope") == "", F.col("entry")).otherwise(F.expr("substring(entry, length(scope) + 2)"))
    subject = F.when(F.col("anchored"), below).otherwise(F.element_at(F.split("entry", "/"), -1))
    hits = each.filter((F.col("entry_dir") | ~F.col("dir_only"))).withColumn("_subject", subject).filter(F.rlike("_subject", "regex"))
    verdict = hits.groupBy("entry", "entry_dir").agg(F.max_by(~F.col("negated"), F.struct("depth", "line_no")).alias("out")).filter("out")
    by_rule = entries.join(verdict, ["entry", "entry_dir"], "left_semi").select("path")
    by_name = paths.filter(always_ignored(F.col("path"))).select("path")
    return by_rule.unionByName(by_name).distinct()
