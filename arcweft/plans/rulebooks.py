"""Rulebooks: declarative rules about what modules may, must and must not import.

A rulebook is YAML: id, name, description and rules; a rule has a target pattern, excludes, and clauses that forbid, allow
or demand imports or demand that modules exist. All rulebooks of a folder are read and compiled together, and either all of
them hold or none does, with one report of everything that is wrong.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import groupby

from arcweft.plans.patterns import Clause, Exclude, PatternError, Target, compile_clause, compile_exclude, compile_target


class RulebookError(Exception):
    """Everything that keeps a folder of rulebooks from being used, as authors read it."""


class RuleConfigError(Exception):
    """A rule that can't be enforced once some module matches it."""


def plural(n: int, word: str) -> str:
    return f"{n} {word}" if n == 1 else f"{n} {word}s"


@dataclass(frozen=True)
class RuleClause:
    pattern: Clause
    transitive: bool = False


@dataclass(frozen=True)
class Rule:
    id: str
    description: str
    fix: str
    target: Target
    exclude: tuple[Exclude, ...] = ()
    forbids: tuple[RuleClause, ...] = ()
    allows: tuple[RuleClause, ...] = ()
    uses: tuple[RuleClause, ...] = ()
    exists: tuple[RuleClause, ...] = ()
    example: str | None = None


@dataclass(frozen=True)
class Rulebook:
    id: str
    name: str
    description: str | None
    rules: tuple[Rule, ...]


@dataclass
class CompileError:
    rule: str
    field: str
    pattern: str
    cause: PatternError

    def __str__(self) -> str:
        body = "\n".join(f"      {line}" for line in str(self.cause).splitlines())
        return f"  rule '{self.rule}'\n    {self.field}: \"{self.pattern}\"\n{body}"


@dataclass
class _Errors:
    found: list[CompileError] = field(default_factory=list)

    def attempt(self, rule: str, where: str, pattern: str, compiler: Callable[[str], object]) -> object | None:
        try:
            return compiler(pattern)
        except PatternError as cause:
            self.found.append(CompileError(rule, where, pattern, cause))
            return None


#: Fields of a rule that hold clauses: key of the pattern, whether an uncertain spelling counts as a match.
CLAUSES = {"forbids": ("import", True), "allows": ("import", False), "uses": ("import", False), "exists": ("module", False)}


def compile_rulebook(raw: dict) -> tuple[Rulebook | None, list[CompileError]]:
    """A rulebook from its YAML mapping, or what is wrong with its patterns, in the order of the file."""
    errors, rules = _Errors(), []
    for r in raw["rules"]:
        before = len(errors.found)
        target = errors.attempt(r["id"], "target", r["target"], compile_target)
        parts: dict[str, tuple] = {"exclude": tuple(errors.attempt(r["id"], "exclude", p, compile_exclude) for p in r["exclude"])}
        if target is not None:  # without it, nothing says what clauses may refer to
            for kind, (key, widen) in CLAUSES.items():
                parts[kind] = tuple(RuleClause(errors.attempt(r["id"], f"{kind}.{key}", c[key], lambda p, w=widen: compile_clause(p, target.variables, w)), c["transitive"]) for c in r[kind])
        if len(errors.found) == before:
            rules.append(Rule(r["id"], r["description"], r["fix"], target, example=r["example"], **parts))
    return (None, errors.found) if errors.found else (Rulebook(raw["id"], raw["name"], raw["description"], tuple(rules)), [])


def parse_rulebook(text: str) -> dict:
    """The mapping of a rulebook's YAML, with defaults; ValueError if it has not the shape of one. Scalars stay text."""
    try:
        import yaml
    except ImportError as e:
        raise RulebookError("reading rulebooks needs PyYAML") from e
    try:
        raw = yaml.load(text, Loader=yaml.BaseLoader)
    except yaml.YAMLError as e:
        raise ValueError(str(e)) from e

    def need(where: dict, key: str, what: str) -> str:
        if not isinstance(where, dict):
            raise ValueError(f"{what} is not a mapping")
        if not isinstance(where.get(key), str):
            raise ValueError(f"{what}: missing field `{key}`")
        return where[key]

    def flag(value: str | None) -> bool:
        if value in (None, "", "~", "null"):
            return False
        if value.lower() not in ("true", "false"):
            raise ValueError(f"transitive: expected true or false, got {value!r}")
        return value.lower() == "true"

    def items(where: dict, key: str) -> list:
        found = where.get(key) or []
        if not isinstance(found, list):
            raise ValueError(f"`{key}` is not a list")
        return found

    if not isinstance(raw, dict):
        raise ValueError("a rulebook is a mapping")
    out = {"id": need(raw, "id", "rulebook"), "name": need(raw, "name", "rulebook"), "description": raw.get("description"), "rules": []}
    for r in items(raw, "rules"):
        rule = {"id": need(r, "id", "rule"), "target": need(r, "target", "rule"), "description": r.get("description") or "", "fix": r.get("fix") or "", "example": r.get("example"), "exclude": items(r, "exclude")}
        for kind, (key, _) in CLAUSES.items():
            rule[kind] = [{key: need(c, key, kind), "transitive": flag(c.get("transitive"))} for c in items(r, kind)]
        out["rules"].append(rule)
    return out


def load_rulebooks(folder: str) -> list[Rulebook]:
    """All rulebooks of a folder, by path; none if there is no such folder. Raises RulebookError for all failures at once."""
    if not os.path.isdir(folder):
        return []
    return read_rulebooks((os.path.join(folder, name), None) for name in sorted(os.listdir(folder)))


def read_rulebooks(files) -> list[Rulebook]:  # noqa: ANN001
    """Rulebooks from (path, text) pairs; text None: read from the path."""
    books, failures = [], []
    for path, text in files:
        try:
            if text is None:
                with open(path, encoding="utf-8") as f:
                    text = f.read()
            book, errors = compile_rulebook(parse_rulebook(text))
        except (OSError, UnicodeDecodeError, ValueError) as e:
            failures.append(path.replace("\\", "/") + "\n" + "\n".join(f"  {line}" for line in str(e).splitlines()))
            continue
        if errors:
            groups = ("\n".join(map(str, g)) for _, g in groupby(errors, key=lambda e: e.rule))
            failures.append(path.replace("\\", "/") + "\n" + "\n".join(groups))
        else:
            books.append(book)
    if failures:
        raise RulebookError(f"Could not load {plural(len(failures), 'rulebook')}.\n\n" + "\n\n".join(failures))
    return books
