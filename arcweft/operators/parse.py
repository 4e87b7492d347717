"""From source text to import statements, without loss.

The lexer knows as much of the language as import statements need. It is total: the texts of its tokens, joined, are the
source. Tokens are found by regular expressions; only the end of an import statement needs counting. `import` is taken as
a statement wherever a token can begin, with no regard to word boundaries or to strings around it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = "path string, ord int, prefix string, target string, suffix string, raw string"


class Token(NamedTuple):
    kind: str  # import, comment, space or raw
    raw: str


class Node(NamedTuple):
    """An import (prefix, target and suffix) or, with target None, other source text."""

    prefix: str | None
    target: str | None
    suffix: str | None
    raw: str


#: A token, by what it begins with. A raw run (and a block comment that never ends) stops before what begins a token.
_RAW = r"[\s\S](?:(?!//|/\*|import)[\s\S])*"
_TOKEN = re.compile(rf"(?P<import>import)|(?P<comment>//[^\n]*\n?|/\*[\s\S]*?\*/)|(?P<open>/\*(?:(?!//|/\*|import)[\s\S])*)|(?P<space>[ \t\n\r\v\f]+)|(?P<raw>{_RAW})")
#: Within a statement: what is skipped whole, or the next character that counts.
_INSIDE = re.compile(r"(?P<skip>\"(?:\\[\s\S]|[^\"\\])*\"|'(?:\\[\s\S]|[^'\\])*'|`(?:\\[\s\S]|[^`\\])*`|//[^\n]*\n?|/\*[\s\S]*?\*/)|(?P<mark>[{}();\n])|[^{}();\n\"'`/]+|[\s\S]")


def _statement_end(text: str, at: int) -> int:
    """Where the statement whose keyword ends at `at` ends: after `;`, line feed or `)` outside of all brackets."""
    depth = 0
    for m in _INSIDE.finditer(text, at):
        if not m["mark"]:
            continue
        depth = max(depth + {"{": 1, "(": 1, "}": -1, ")": -1}.get(m["mark"], 0), 0)
        if not depth and m["mark"] in ";\n)":
            return m.end() + (text[m.end() : m.end() + 1] == ";")
    return len(text)


def lex(text: str) -> Iterator[Token]:
    at = 0
    while m := _TOKEN.match(text, at):
        at = _statement_end(text, m.end()) if m["import"] else m.end()
        kind = "comment" if m.lastgroup == "open" else m.lastgroup
        yield Token(kind, text[m.start() : at])


def split_import(raw: str) -> Node:
    """An import token cut at its specifier: the first quote outside of braces, to the same quote or the end.

    Braces may go below zero here and so hide what follows. Without a quote or with nothing behind it, no import.
    """
    depth = 0
    for m in re.finditer(r"[{}'\"]", raw):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if m[0] in "'\"" and not depth:
            end = raw.find(m[0], m.end())
            end = len(raw) if end < 0 else end
            return Node(raw[: m.end()], raw[m.end() : end], raw[end:], raw) if end > m.end() else Node(None, None, None, raw)
    return Node(None, None, None, raw)


def parse(text: str) -> Iterator[Node]:
    for token in lex(text):
        yield split_import(token.raw) if token.kind == "import" else Node(None, None, None, token.raw)


def render(nodes: Iterator[Node]) -> str:
    return "".join(n.raw if n.target is None else n.prefix + n.target + n.suffix for n in nodes)


# --- as DataFrames ---


def nodes(files: DataFrame) -> DataFrame:
    """All nodes of all files (path, content), as NODES; neighbouring texts without import come as one node.

    Files are parsed in Arrow batches, each on its own. Null contents (unreadable files) give no rows, empty files one
    row with an empty text, so that they still count as modules.
    """

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                if content is None:
                    continue
                plain, n = [], 0
                for node in parse(content):
                    if node.target is None:
                        plain.append(node.raw)
                        continue
                    if plain:
                        rows.append((path, n, None, None, None, "".join(plain)))
                        plain, n = [], n + 1
                    rows.append((path, n, node.prefix, node.target, node.suffix, None))
                    n += 1
                if plain or not n:
                    rows.append((path, n, None, None, None, "".join(plain)))
            yield pd.DataFrame(rows, columns=["path", "ord", "prefix", "target", "suffix", "raw"])

    return files.select("path", "content").mapInPandas(parsed, NODES)


def rendered(nodes: DataFrame) -> DataFrame:
    """(path, content): each file's nodes written out in order."""
    text = F.coalesce(F.concat("prefix", "target", "suffix"), F.col("raw"))
    parts = F.array_sort(F.collect_list(F.struct("ord", text.alias("text"))))
    return nodes.groupBy("path").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("content"))


def imports(nodes: DataFrame) -> DataFrame:
    """(path, ord, target, raw_statement) of the import nodes."""
    return nodes.filter("target is not null").select("path", "ord", "target", F.concat("prefix", "target", "suffix").alias("raw_statement"))
