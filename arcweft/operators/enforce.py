"""Rules as joins: which modules a rule is about, and what of their imports it forbids, allows or misses.

All targets are tested in one pass over the modules: each is a literal regular expression (behind an equality on the first
segment where that is literal), and hits are exploded, instead of a nested loop over modules and rules. Rules whose clauses
mean the same for every match, and whose texts take names only as they were captured, stay expressions. On hits of the others
an Arrow function settles captures and writes each clause out for this match, once. Clauses that mean the same for every
match stay literal expressions; only those with variables are compared column against column.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from arcweft.functions.casing import Casing
from arcweft.operators.graph import chains_through, reachable, sifted
from arcweft.operators.problems import DIRECT, MISSING_MODULE, MISSING_USE, RULE, TRANSITIVE, none, shaped, trim
from arcweft.plans.lineage import cut
from arcweft.plans.patterns import STAR, Bound, Env, Var, interpolate
from arcweft.plans.rulebooks import CLAUSES, Rule, RuleConfigError, Rulebook

CLAUSE = "struct<kind:string,no:int,transitive:boolean,static_no:int,regex:string,text:string>"
CLAUSES_TYPE = f"array<{CLAUSE}>"
MATCH = f"target_dir string, prose string, fix string, variables map<string, struct<pascal:string,camel:string,constant:string,kebab:string,candidates:array<array<string>>>>, clauses {CLAUSES_TYPE}"
#: Fixed value: matches whose texts a task keeps written out.
MOST_WRITTEN = 4096


@dataclass(frozen=True)
class Ruleset:
    """Rules of several rulebooks in order, and the literal expressions among their clauses."""

    rules: tuple[tuple[str, Rule], ...]
    literals: tuple[str, ...]

    @staticmethod
    def of(rulebooks: list[Rulebook]) -> Ruleset:
        rules = tuple((book.id, rule) for book in rulebooks for rule in book.rules)
        empty = Env("")
        found = dict.fromkeys(c.pattern.regex(empty) for _, r in rules for kind in CLAUSES for c in getattr(r, kind) if kind != "exists" and c.pattern.is_static)
        return Ruleset(rules, tuple(found))


def slashed(column: str) -> Column:
    return F.concat(column, F.lit("/"))


def is_target(rule: Rule, module_id: str = "module_id") -> Column:
    """Whether the rule's target and none of its excludes matches; for targets that repeat a variable, whether it may."""
    test = slashed(module_id).rlike(rule.target.regex)
    if rule.target.head is not None:
        test = F.col(module_id).startswith(rule.target.head) & test
    for pattern in rule.exclude:
        test = test & ~slashed(module_id).rlike(pattern.regex)
    return test


def _hits(modules: DataFrame, rules: Ruleset, numbers: list[int]) -> DataFrame:
    """(module_id, path, rule_no) for each module and each of these rules whose expressions let it through."""
    if not numbers:
        return modules.filter(F.lit(False)).select("module_id", "path", F.lit(0).alias("rule_no"))
    hits = F.array_compact(F.array(*[F.when(is_target(rules.rules[i][1]), F.lit(i)) for i in numbers]))
    return modules.select("module_id", "path", F.explode(hits).alias("rule_no"))


def _clauses(rule: Rule, env: Env, rules: Ruleset, static: bool | None = None) -> list[dict]:
    """The rule's clauses as rows hold them: all, or only those that are (or are not) the same for every match."""
    out = []
    for kind in CLAUSES:
        for no, c in enumerate(getattr(rule, kind)):
            if static is not None and c.pattern.is_static != static:
                continue
            regex = c.pattern.regex(env) if kind != "exists" else None
            text = c.pattern.module(env) if kind == "exists" else c.pattern.shown(env) if kind == "uses" else None
            literal = rules.literals.index(regex) if c.pattern.is_static and kind != "exists" else None
            out.append({"kind": kind, "no": no, "transitive": c.transitive, "static_no": literal, "regex": regex, "text": text})
    return out


def matches(modules: DataFrame, rules: Ruleset, numbers: list[int] | None = None) -> DataFrame:
    """(module_id, path, rule_no, MATCH columns) for each module and rule (of these numbers) whose target it is.

    Rows go through Arrow as lists; what a rule says is written out once for matches that bind the same.
    """
    found = _hits(modules, rules, list(range(len(rules.rules))) if numbers is None else numbers)
    schema = T.StructType.fromDDL(f"module_id string, path string, rule_no int, {MATCH}")
    types = [to_arrow_type(f.dataType) for f in schema]
    names = schema.names

    def bind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        static = [_clauses(rule, Env(""), rules, True) for _, rule in rules.rules]
        written: dict[tuple, tuple] = {}
        for batch in batches:
            rows: list[tuple] = []
            for module_id, path, no in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rule = rules.rules[no][1]
                if (env := rule.target.match(module_id)) is None:
                    continue
                key = (no, env.directory, tuple((n, tuple(b.texts.values())) for n, b in env.variables.items()))
                if key not in written:
                    if len(written) >= MOST_WRITTEN:
                        written.clear()
                    plain = env.plain()
                    clauses = [*static[no], *_clauses(rule, env, rules, False)]
                    written[key] = (plain["target_dir"], interpolate(env, rule.description), interpolate(env, rule.fix), list(plain["variables"].items()), clauses)
                rows.append((module_id, path, no, *written[key]))
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return found.mapInArrow(bind, schema)


def _template(rule: Rule, text: str) -> Column | None:
    """Prose of a rule as an expression of module_id; None if it takes a name in a casing that the target does not capture."""
    captured = {p.name: p.casing for s in rule.target.segments if s != STAR for p in s if isinstance(p, Var)}
    names = list(rule.target.variables)
    mark = lambda i: f"\0{i}\0"
    env = Env(mark(0), {n: Bound({c.name: mark(names.index(n) + 1) if c == captured[n] else mark("?") for c in Casing}, ()) for n in names})
    pieces = interpolate(env, text).split("\0")
    if "\0" in text or "?" in pieces[1::2]:
        return None
    values = [F.regexp_replace("module_id", r"(?s)/?[^/]*\z", "")] + [F.regexp_extract(slashed("module_id"), rule.target.regex, i + 1) for i in range(len(names))]
    return F.concat(*[values[int(x)] if i % 2 else F.lit(x) for i, x in enumerate(pieces)])


def _is_plain(rule: Rule) -> bool:
    """Whether expressions say all that a match means: they are exact without repeated variables, and clauses and texts need no other casing."""
    static = all(c.pattern.is_static for kind in CLAUSES for c in getattr(rule, kind))
    return static and not rule.target.repeats and all(_template(rule, text) is not None for text in (rule.description, rule.fix))


def targeted(modules: DataFrame, rules: Ruleset) -> DataFrame:
    """(module_id, path, rule_no, prose, fix, clauses) of `matches`; rules that need no matcher never leave the JVM.

    Clauses of plain rules are literals, added behind the checkpoint.
    """
    columns = ["module_id", "path", "rule_no", "prose", "fix"]
    plain = [i for i, (_, r) in enumerate(rules.rules) if _is_plain(r)]
    other = [i for i in range(len(rules.rules)) if i not in plain]
    parts = []
    if plain:
        pick = lambda values: reduce(lambda rest, x: F.when(F.col("rule_no") == x[0], x[1]).otherwise(rest), values, F.lit(None).cast("string"))
        texts = {name: pick([(i, _template(rules.rules[i][1], getattr(rules.rules[i][1], of))) for i in plain]) for name, of in (("prose", "description"), ("fix", "fix"))}
        literal = reduce(lambda rest, i: F.when(F.col("rule_no") == i, _literal(_clauses(rules.rules[i][1], Env(""), rules))).otherwise(rest), plain, F.lit(None).cast(CLAUSES_TYPE))
        parts.append(cut(_hits(modules, rules, plain).withColumns(texts).select(columns)).withColumn("clauses", literal))
    if other:
        parts.append(cut(matches(modules, rules, other).select(*columns, "clauses")))
    return reduce(DataFrame.unionByName, parts)


def _literal(clauses: list[dict]) -> Column:
    fixed = [F.struct(*[F.lit(v).alias(k) for k, v in c.items()]).cast(CLAUSE) for c in clauses]
    return F.array(*fixed).cast(CLAUSES_TYPE)


def _accepts(clause: Column, text: Column, rules: Ruleset) -> Column:
    """Whether a clause's expression matches the text: by a literal where it is static, else by its own."""
    by_literal = F.lit(None).cast("boolean")
    for i, x in enumerate(rules.literals):
        by_literal = F.when(clause["static_no"] == i, text.rlike(x)).otherwise(by_literal)
    dynamic = F.rlike(text, F.when(clause["static_no"].isNull(), clause["regex"]))
    return F.when(clause["static_no"].isNotNull(), by_literal).otherwise(dynamic)


def enforce(modules: DataFrame, imports: DataFrame, edges: DataFrame, vertices: DataFrame, rulebooks: list[Rulebook]) -> DataFrame:
    """All problems that the rules find.

    modules (module_id, path), imports (module_id, path, ord, target, raw_statement), edges (src, dst, ord), vertices
    (id). Raises RuleConfigError if a module matches a rule that demands a module by a pattern with wildcards.
    """
    rules = Ruleset.of(rulebooks)
    if not rules.rules:
        return none(modules.sparkSession)
    found = targeted(modules, rules)
    _check_exists(found, rules)
    each = found.select("module_id", "path", "rule_no", "prose", "fix", F.filter("clauses", lambda c: c["kind"] == "allows").alias("_allows"), F.explode("clauses").alias("clause"))
    of = lambda kind: each.filter(F.col("clause.kind") == kind)
    kinds = {(kind, c.transitive) for _, r in rules.rules for kind in CLAUSES for c in getattr(r, kind)}
    reach = through = None
    if {("forbids", True), ("uses", True)} & kinds:
        sources = each.filter(F.col("clause.transitive") & F.col("clause.kind").isin("forbids", "uses")).select(F.col("module_id").alias("src"))
        clauses = [c for _, r in rules.rules for c in (*r.forbids, *r.uses) if c.transitive]
        if all(c.pattern.is_static for c in clauses):  # only what a clause speaks of has to be reached
            spoken_of = reduce(or_, [slashed("id").rlike(c.pattern.regex(Env(""))) for c in clauses])
            reach, through = chains_through(edges, sources, vertices.filter(spoken_of).select(F.col("id").alias("dst")))
        else:
            reach = reachable(edges, sources)
        both = {("forbids", True), ("uses", True)} <= kinds  # what is read once needs no checkpoint
        reach = (cut(reach) if both else reach).withColumnRenamed("src", "module_id")
    named = lambda rows: _named(rows, rules)
    out = [none(modules.sparkSession)]
    target = slashed("target")
    if ("forbids", False) in kinds:
        direct = [c for _, r in rules.rules for c in r.forbids if not c.transitive]
        some = imports.select("path", "target", "raw_statement")
        if all(c.pattern.is_static for c in direct):  # only what a clause speaks of has to meet its module
            some = some.filter(reduce(or_, [target.rlike(x) for x in dict.fromkeys(c.pattern.regex(Env("")) for c in direct)]))
        rows = of("forbids").filter(~F.col("clause.transitive")).join(some, "path").filter(_accepts(F.col("clause"), target, rules) & ~_allowed(target, rules))
        out.append(shaped(named(rows.withColumns({"kind_ord": F.lit(DIRECT), "imported": F.col("target"), "import_statement": trim(F.col("raw_statement"))}))))
    if ("forbids", True) in kinds:
        reached = slashed("dst")
        rows = of("forbids").filter("clause.transitive").join(reach, "module_id").filter(_accepts(F.col("clause"), reached, rules) & ~_allowed(reached, rules))
        rows = rows.withColumn("_hop", F.try_element_at("chain", F.lit(2)))
        # Reach, modules and imports meet by module, so that each is exchanged once; the rest of the key is no equality, which would deal all of them out again.
        first = (imports if through is None else sifted(imports, "target", through)).repartition("module_id")
        first = first.groupBy("module_id", F.col("path").alias("_path"), F.col("target").alias("_to")).agg(F.min_by("raw_statement", "ord").alias("_raw")).withColumnRenamed("module_id", "_id")
        rows = rows.join(first, (F.col("module_id") == F.col("_id")) & F.col("path").between(F.col("_path"), F.col("_path")) & F.col("_hop").between(F.col("_to"), F.col("_to")), "left")
        out.append(shaped(named(rows.withColumns({"kind_ord": F.lit(TRANSITIVE), "first_import": trim(F.col("_raw")), "also_reached": F.array().cast("array<array<string>>")}))))
    key = ["path", "rule_no", F.col("clause.no").alias("_no")]
    for transitive in (False, True):
        if ("uses", transitive) not in kinds:
            continue
        wanted = of("uses").filter(F.col("clause.transitive") == transitive)
        if transitive:
            has = wanted.join(reach.select("module_id", "dst"), "module_id").filter(_accepts(F.col("clause"), slashed("dst"), rules))
        else:
            has = wanted.join(imports.select("path", "target"), "path").filter(_accepts(F.col("clause"), target, rules))
        missing = wanted.withColumn("_no", F.col("clause.no")).join(has.select(*key).distinct(), ["path", "rule_no", "_no"], "left_anti")
        out.append(shaped(named(missing.withColumns({"kind_ord": F.lit(MISSING_USE), "required_import": F.col("clause.text"), "transitive": F.lit(transitive)}))))
    if ("exists", False) in kinds:
        missing = of("exists").withColumn("required_module", F.col("clause.text")).join(vertices.select(F.col("id").alias("required_module")), "required_module", "left_anti")
        out.append(shaped(named(missing.withColumn("kind_ord", F.lit(MISSING_MODULE)))))
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def _allowed(text: Column, rules: Ruleset) -> Column:
    return F.exists("_allows", lambda a: F.coalesce(_accepts(a, text, rules), F.lit(False)))


def _named(rows: DataFrame, rules: Ruleset) -> DataFrame:
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("rule_no") + 1)
    return rows.withColumns({
        "type_ord": F.lit(RULE), "rulebook_id": pick([b for b, _ in rules.rules]), "rule_id": pick([r.id for _, r in rules.rules]), "bad_module": F.col("module_id"), "rule_fix": F.col("fix"),
        "seq": F.array("rule_no", "clause.no"),
    })


def _check_exists(found: DataFrame, rules: Ruleset) -> None:
    bad = [i for i, (_, r) in enumerate(rules.rules) if any(c.pattern.has_wildcard for c in r.exists)]
    if bad and (row := found.filter(F.col("rule_no").isin(bad)).agg(F.min(F.struct(F.split("path", "/"), "rule_no").alias("first")).alias("first")).first().first):
        book, rule = rules.rules[row.rule_no]
        raise RuleConfigError(f"Invalid rule configuration: Rule '{rule.id}' in rulebook '{book}': 'exists' patterns must not contain wildcards (* or **).")
