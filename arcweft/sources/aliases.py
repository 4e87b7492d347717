"""Compiler configuration: base folder and path aliases of a project.

The configuration is JSON with comments. Aliases map a key with at most one `*` to patterns of the same kind; they are
lowered to rows in order of precedence, which the resolver joins.
"""

from __future__ import annotations

import json
import posixpath
import re
from dataclasses import dataclass


class ConfigError(Exception):
    """A configuration that is missing or can't be read."""


@dataclass(frozen=True)
class AliasPattern:
    """Text before and after the `*`; after is None for an exact pattern."""

    before: str
    after: str | None = None

    @staticmethod
    def parse(text: str) -> AliasPattern | None:
        """None for what is no pattern: empty, or with more than one `*`."""
        if not text or text.count("*") > 1:
            return None
        before, star, after = text.partition("*")
        return AliasPattern(before, after if star else None)

    @property
    def exact(self) -> bool:
        return self.after is None

    def capture(self, text: str) -> str | None:
        """What the `*` stands for; empty for an equal exact pattern; None if it does not match."""
        if self.exact:
            return "" if text == self.before else None
        fits = len(text) >= len(self.before) + len(self.after) and text.startswith(self.before) and text.endswith(self.after)
        return text[len(self.before) : len(text) - len(self.after)] if fits else None

    def put(self, capture: str) -> str:
        return self.before if self.exact else self.before + capture + self.after


@dataclass(frozen=True)
class Alias:
    key: AliasPattern
    values: tuple[AliasPattern, ...]


@dataclass(frozen=True)
class Config:
    """Absolute base folder and aliases, the one to try first in front."""

    base_url: str
    aliases: tuple[Alias, ...]


#: A string literal, a line comment, a block comment, or a quote or comment that never ends.
_PIECE = re.compile(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/|("|/\*)', re.DOTALL)


def strip_comments(text: str) -> str:
    """JSON without comments; ValueError for a string or block comment without end. Comma rules stay those of JSON."""

    def keep(m: re.Match[str]) -> str:
        if m[2]:
            raise ValueError("unterminated " + ("string" if m[2] == '"' else "comment"))
        return m[1] or ""

    return _PIECE.sub(keep, text)


def parse_alias(key: str, values: list[str]) -> Alias | None:
    """None if key or all values are unusable. An exact key takes no `*` values; `./` in front of values means nothing."""
    k = AliasPattern.parse(key)
    if k is None:
        return None
    found = []
    for v in map(AliasPattern.parse, values):
        if v is not None and not (k.exact and not v.exact):
            found.append(AliasPattern("" if v.before == "." else re.sub(r"\A(?:\./)+(?:\.\Z)?", "", v.before), v.after))
    return Alias(k, tuple(found)) if found else None


def parse_config(text: str, folder: str) -> Config:
    """The configuration in `folder`: baseUrl (default `.`) and paths; keys it does not know play no part."""
    try:
        raw = json.loads(strip_comments(text))
        options = raw.get("compilerOptions", {})
        base, paths = options.get("baseUrl"), options.get("paths") or {}
        if not (base is None or isinstance(base, str)) or not all(isinstance(v, list) and all(isinstance(x, str) for x in v) for v in paths.values()):
            raise ValueError("unexpected type in compilerOptions")
    except (ValueError, AttributeError) as e:
        raise ConfigError(f"Could not parse TS config, check: '{e}'") from e
    aliases = [a for k in sorted(paths) if (a := parse_alias(k, paths[k]))]
    rank = lambda a: (a.key.exact, len(a.key.before), len(a.key.after or ""))  # noqa: E731  exact first, then longer texts
    return Config(posixpath.join(folder, "." if base is None else base), tuple(sorted(aliases, key=rank, reverse=True)))


def load_config(path: str) -> Config:
    try:
        with open(path, encoding="utf-8") as f:
            return parse_config(f.read(), posixpath.dirname(path) or ".")
    except FileNotFoundError as e:
        raise ConfigError(f"tsconfig.json not found in '{path}'") from e
