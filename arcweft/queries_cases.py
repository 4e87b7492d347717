"""Queries over cases that derived graphs do not hold: odd spellings, repeated variables, lexer and ignore-file edges, aliases that
compete, texts of reports, errors, and whole runs over a small project. Each has SQL that states the expected rows on its own.

Cases are fixed values, mostly crossed with rows of the bundled tables.
"""

from __future__ import annotations

import contextlib
import io
import os
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweft import __main__ as cli
from arcweft import api
from arcweft.functions.casing import Casing, decodings, renderings, spells
from arcweft.operators import graph, parse, problems, resolve
from arcweft.operators.enforce import Ruleset, enforce, matches
from arcweft.plans import derived, patterns, report
from arcweft.plans.derived import table
from arcweft.plans.lineage import shared_folder
from arcweft.plans.rulebooks import RulebookError, read_rulebooks
from arcweft.sources import ignore
from arcweft.sources.aliases import parse_config
from arcweft.sources.store import write_text


def quoted(text: str | bool | None) -> str:
    """An SQL literal."""
    return "NULL" if text is None else str(text).lower() if isinstance(text, bool) else "'" + text.replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(str(x) if isinstance(x, int) and not isinstance(x, bool) else quoted(x) for x in r) + ")" for r in rows) + ")"


def each(rows: DataFrame, cases: list[tuple], *names: str) -> DataFrame:
    """Every row with every one of some fixed cases."""
    fixed = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(case, names, strict=True)]) for case in cases])
    return rows.withColumn("_case", F.explode(fixed)).select(*rows.columns, "_case.*")


def _project(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    modules, imports = derived.as_project(edges)
    return modules, imports, edges, graph.vertices_of(edges, modules)


def _books(rules: str) -> list:
    return read_rulebooks([("cases.yaml", "id: cases\nname: Cases\nrules:\n" + rules)])


# --- spellings ---

#: Spellings of AWSS3 and a word in kebab-case: whether a forbidding clause takes them for the name, and an allowing one.
SPLITS = [("awss3-", True, True), ("aws-s3-", True, False), ("a-w-s-s-3-", True, False), ("aw-ss3-", True, False), ("awss3", False, False), ("aws--s3-", False, False), ("awss-", False, False)]
WIDE = "  - {id: wide, target: '@/f/{{FileName}}', forbids: [{import: '@/t/{{file-name}}'}]}\n"
NARROW = "  - {id: narrow, target: '@/f/{{FileName}}', forbids: [{import: '@/t/*'}], allows: [{import: '@/t/{{file-name}}'}]}\n"


def rule_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules named after segments, with imports in all spellings: which ones the two rules object to."""
    segments = table(spark, sf_dir, "customer").select(F.initcap("c_mktsegment").alias("s")).distinct()
    cases = each(segments, [(i, text) for i, (text, *_) in enumerate(SPLITS)], "ord", "split")
    edges = cases.select(F.concat(F.lit("@/f/AWSS3"), "s").alias("src"), F.concat(F.lit("@/t/"), "split", F.lower("s")).alias("dst"), "ord")
    return enforce(*_project(edges), _books(WIDE + NARROW)).select("problem_id", "imported")


SPELLINGS_SQL = f"""WITH s AS (SELECT DISTINCT lower(c_mktsegment) AS s FROM customer), c AS (SELECT * FROM {values(SPLITS)} v(split, wide, narrow)),
m AS (SELECT concat('@/f/AWSS3', upper(s[1]), s[2:]) AS id, concat('@/t/', split, s) AS imported, wide, narrow FROM s, c)
SELECT concat('cases#wide#', id) AS problem_id, imported FROM m WHERE wide UNION ALL SELECT concat('cases#narrow#', id), imported FROM m WHERE NOT narrow"""

#: Two-letter words, and forms of all nine words: a bit each, set for capitals. Spellings count up to the 256th, in this order.
FORMS = [0, 1, 2, 170, 255, 256, 257, 384, 511]


def rule_most_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name of nine words has 512 spellings, of which a forbidding clause knows 256."""
    words = ["".join(chr(97 + i) for _ in range(2)) for i in range(8)]
    segments = table(spark, sf_dir, "customer").select(F.lower("c_mktsegment").alias("s")).distinct()
    all_words = [*map(F.lit, words), F.col("s")]
    spelled = [F.when(F.shiftright("ord", 8 - i).bitwiseAND(F.lit(1)) == 1, F.upper(w)).otherwise(F.initcap(w)) for i, w in enumerate(all_words)]
    edges = each(segments, [(n,) for n in FORMS], "ord").select(F.concat(F.lit(f"@/g/{'-'.join(words)}-"), "s").alias("src"), F.concat(F.lit("@/t/"), *spelled).alias("dst"), "ord")
    return enforce(*_project(edges), _books("  - {id: most, target: '@/g/{{file-name}}', forbids: [{import: '@/t/{{FileName}}'}]}\n")).select("problem_id", "imported")


_BIG = ", ".join(f"CASE WHEN n & {1 << (8 - i)} > 0 THEN '{chr(65 + i) * 2}' ELSE '{chr(65 + i)}{chr(97 + i)}' END" for i in range(8))
MOST_SQL = f"""SELECT concat('cases#most#@/g/aa-bb-cc-dd-ee-ff-gg-hh-', s) AS problem_id, concat('@/t/', {_BIG}, CASE WHEN n & 1 > 0 THEN upper(s) ELSE concat(upper(s[1]), s[2:]) END) AS imported
FROM (SELECT DISTINCT lower(c_mktsegment) AS s FROM customer), {values([(n,) for n in FORMS])} f(n) WHERE n < 256"""


def pattern_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that repeat a variable: all occurrences have to stand for one name."""
    rules = "  - {id: twice, target: '@/c/{{provider-name}}/{{provider-name}}-{{service-type}}'}\n  - {id: casings, target: '@/x/{{NationName}}/{{nation-name}}'}\n"
    customer = table(spark, sf_dir, "customer").select(F.lower("c_mktsegment").alias("s"), "c_custkey")
    other = F.when(F.col("c_custkey") % 3 == 0, F.lit("nobody")).otherwise(F.col("s"))
    one = customer.select(F.concat(F.lit("@/c/"), "s", F.lit("/"), other, F.lit("-c-"), "c_custkey").alias("module_id"))
    nation = table(spark, sf_dir, "nation").select(F.initcap(F.regexp_replace("n_name", "_", " ")).alias("n"), "n_nationkey")
    kebab = F.concat(F.lower(F.regexp_replace("n", " ", "-")), F.when(F.col("n_nationkey") % 2 == 0, "s").otherwise(""))
    two = nation.select(F.concat(F.lit("@/x/"), F.regexp_replace("n", " ", ""), F.lit("/"), kebab).alias("module_id"))
    found = matches(one.unionByName(two).withColumn("path", F.col("module_id")), Ruleset.of(_books(rules)))
    pick = lambda name: F.col("variables")[name]["kebab"]
    return found.select("module_id", "target_dir", pick("provider-name").alias("provider"), pick("service-type").alias("service"), pick("nation-name").alias("nation"))


AGREEMENT_SQL = """SELECT concat('@/c/', s, '/', s, '-c-', c_custkey) AS module_id, concat('@/c/', s) AS target_dir, s AS provider, concat('c-', c_custkey) AS service, NULL::VARCHAR AS nation FROM (SELECT lower(c_mktsegment) AS s, c_custkey FROM customer) WHERE c_custkey % 3 <> 0
UNION ALL SELECT concat('@/x/', n, '/', k), concat('@/x/', n), NULL, NULL, k FROM (SELECT replace(concat(upper(n_name[1]), lower(n_name[2:])), '_', '') AS n, replace(lower(n_name), '_', '-') AS k, n_nationkey FROM nation) WHERE n_nationkey % 2 <> 0"""


def casing_decodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitals in a row split at every letter, up to 64 ways; words of two letters are spelled in two ways each."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for n in batch["n"]:
                letters, words = "ABCDEFGHIJKLMNOPQRSTUVWXY"[:n], tuple(chr(97 + i) * 2 for i in range(min(n, 10)))
                found = decodings(Casing.PASCAL, letters)
                forms = list(renderings(Casing.PASCAL, words))
                out.append((n, len(found), "-".join(found[0]), len(set(forms)), all(spells(Casing.PASCAL, words, f) for f in forms), spells(Casing.PASCAL, words, forms[0].lower()), len(decodings(Casing.PASCAL, letters + "-"))))
            yield pd.DataFrame(out, columns=["n", "readings", "first", "spellings", "spelled", "lower_spelled", "dead_ends"])

    numbers = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).cast("int").alias("n"))
    return numbers.mapInPandas(rows, "n int, readings int, first string, spellings int, spelled boolean, lower_spelled boolean, dead_ends int")


DECODINGS_SQL = """SELECT (n_nationkey + 1)::INT AS n, least(1 << least(n_nationkey, 6), 64)::INT AS readings, lower('ABCDEFGHIJKLMNOPQRSTUVWXY'[1:n_nationkey + 1]) AS first,
  (1 << least(n_nationkey + 1, 10))::INT AS spellings, true AS spelled, false AS lower_spelled, 1::INT AS dead_ends FROM nation"""

#: Compiler, pattern, kind of the error.
ERRORS = [
    ("target", "@/x/{{provider}}", "ambiguous-casing"), ("target", "@/x/{{Provider-Name}}", "unrecognised-casing"), ("target", "@/x/{{HTTPClient}}", "consecutive-capitals"), ("target", "@/x/{{TARGET_DIR}}", "directory-in-target"),
    ("target", "@/../x", "parent-in-target"), ("target", "@/**View", "glued-globstar"), ("target", "**/{{some-name}}/**", "unanchored"), ("target", "@/{{someName}}*{{otherName}}", "no-boundary"), ("target", "@/{{some", "malformed"),
    ("exclude", "@/{{some-name}}", "variable-in-exclude"), ("exclude", "../x", "parent-in-exclude"), ("clause", "@/{{provider-nam}}", "unbound"), ("clause", "@/**/../x", "parent-past-wildcard"), ("clause", "@/{{target-dir}}", "reserved-name"),
    ("target", "@/a/*", None), ("exclude", "**/*.test", None), ("clause", "../{{provider-name}}", None),
]
#: The first lines of what authors read about them.
SAID = {
    "ambiguous-casing": "{{provider}} is ambiguous: a single-word name reads as both camelCase and kebab-case.", "unrecognised-casing": "{{Provider-Name}} is not written in a recognised casing.",
    "consecutive-capitals": "{{HTTPClient}} contains consecutive capitals, so its word boundaries are ambiguous.", "directory-in-target": "{{TARGET_DIR}} cannot be used in a target pattern.", "parent-in-target": '".." cannot be used in a target pattern.',
    "glued-globstar": '"**View" glues ** to text inside a single path segment.', "unanchored": "{{some-name}} has ** on both sides, so nothing in the pattern says which",
    "no-boundary": "{{someName}}{{otherName}} has no literal between the two variables, so there", "malformed": 'invalid Glob+ pattern "@/{{some"', "variable-in-exclude": "{{some-name}} cannot be used in an exclude pattern.",
    "parent-in-exclude": '".." cannot be used in an exclude pattern.', "unbound": "unknown variable {{provider-nam}}.", "parent-past-wildcard": '".." cannot go back past "**".', "reserved-name": "{{target-dir}} is reserved.",
}


def pattern_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the compilers of patterns object to."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compilers = {"target": patterns.compile_target, "exclude": patterns.compile_exclude, "clause": lambda t: patterns.compile_clause(t, ("provider-name",), False)}
        for batch in batches:
            out = []
            for where, pattern in zip(batch["place"], batch["pattern"], strict=True):
                try:
                    compilers[where](pattern)
                    out.append((where, pattern, None, None))
                except patterns.PatternError as e:
                    out.append((where, pattern, e.kind, str(e).split("\n")[0]))
            yield pd.DataFrame(out, columns=["place", "pattern", "kind", "said"])

    return spark.createDataFrame([(w, p) for w, p, _ in ERRORS], "place string, pattern string").mapInPandas(rows, "place string, pattern string, kind string, said string")


ERRORS_SQL = f"SELECT place, pattern, kind::VARCHAR AS kind, said::VARCHAR AS said FROM {values([(w, p, k, SAID.get(k)) for w, p, k in ERRORS])} v(place, pattern, kind, said)"


def near_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variables that a misspelled one may have meant, as the compiler of clauses suggests it: the nearest within three edits."""
    known = table(spark, sf_dir, "customer").select(F.concat(F.lit("market-"), F.lower("c_mktsegment")).alias("known")).distinct()
    bound = tuple(r.known for r in known.collect())  # a rule's variables
    asked = known.select(F.regexp_replace("known", "[aeiou](.)$", "$1").alias("asked")).unionByName(known.select(F.concat("known", F.lit("-and-more")).alias("asked"))).distinct()

    def suggest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            meant = []
            for name in batch["asked"]:
                try:
                    patterns.compile_clause(f"@/{patterns.braced(name)}", bound, False)
                    meant.append(name)
                except patterns.PatternError as e:
                    meant.append(str(e).partition("Did you mean {{")[2].partition("}}")[0] or None)
            yield pd.DataFrame({"asked": batch["asked"], "meant": meant})

    return asked.mapInPandas(suggest, "asked string, meant string")


NEAR_SQL = """WITH k AS (SELECT DISTINCT concat('market-', lower(c_mktsegment)) AS known FROM customer),
a AS (SELECT regexp_replace(known, '[aeiou](.)$', '\\1') AS asked FROM k UNION SELECT concat(known, '-and-more') FROM k)
SELECT asked, arg_min(known, (levenshtein(asked, known), known)) FILTER (levenshtein(asked, known) <= 3) AS meant FROM a, k GROUP BY asked"""

BROKEN = "id: a\nname: A\nrules:\n - id: r\n   target: '@/{{provider}}'\n   exclude: ['../x']\n - id: s\n   target: x\n   uses: [{import: '@/{{some-nam}}'}]\n"
BROKEN_LINES = [
    (0, "Could not load 2 rulebooks."), (1, "  rule 'r'"), (2, '    target: "@/{{provider}}"'), (3, '    exclude: "../x"'), (4, "  rule 's'"), (5, '    uses.import: "@/{{some-nam}}"'), (6, "        Variables bound by this rule's target: (none)"),
]


def rulebook_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the one report on all rulebooks that can't be loaded; no rule of a sound one is loaded then."""
    try:
        read_rulebooks([("a.yaml", BROKEN), ("b.yaml", "name: no id"), ("c.yaml", "id: c\nname: C\nrules: [{id: ok, target: '**'}]\n")])
        said = ""
    except RulebookError as e:
        said = str(e)
    lines = said.split("\n")
    return spark.createDataFrame([(i, line) for i, line in BROKEN_LINES if line in lines] + [(7, str("missing field `id`" in said)), (8, str("c.yaml" in said))], "no int, line string")


RULEBOOK_ERRORS_SQL = f"SELECT no::INT AS no, line FROM {values([*BROKEN_LINES, (7, 'True'), (8, 'False')])} v(no, line)"

# --- reports ---


def _star(spark: SparkSession, sf_dir: str, *ids: str) -> DataFrame:
    from arcweft.queries import _enforced

    return _enforced(spark, sf_dir, *ids)


def report_transitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of transitive imports, with what was absorbed."""
    return problems.formatted(problems.compacted(_star(spark, sf_dir, "orders-know-no-region"))).select("problem_id", "text")


def report_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of missing imports and modules."""
    return problems.formatted(_star(spark, sf_dir, "customers-in-asia")).select("problem_id", "text")


def report_transitive_sql(chains: str) -> str:
    return f"""WITH {chains}, v AS (SELECT src, chain, row_number() OVER (PARTITION BY src ORDER BY len(chain), chain) AS k FROM short WHERE starts_with(src, '@/orders/') AND starts_with(dst, '@/region/')),
s AS (SELECT src, chain FROM v WHERE k = 1),
h AS (SELECT v.src, v.chain[2] AS hop, min(k) AS k FROM v JOIN s USING (src) WHERE k > 1 AND v.chain[2] <> s.chain[2] GROUP BY v.src, v.chain[2]),
t AS (SELECT src, count(*) AS hops, string_agg(concat('''', hop, ''''), ', ' ORDER BY k) AS names FROM h GROUP BY src),
n AS (SELECT src, count(*) - 1 AS more FROM v GROUP BY src)
SELECT concat('star#orders-know-no-region#', src) AS problem_id, concat('# star#orders-know-no-region#', src, chr(10), '@/orders stands above regions', chr(10), chr(10), 'Module ''', src, ''' transitively imports ''', chain[-1], ''' (',
  len(chain) - 1, ' hops) via: ', array_to_string(chain, ' → '), '.', chr(10), '```ts', chr(10), 'import x from ''', chain[2], ''';', chr(10), '```',
  CASE WHEN more > 0 THEN concat(chr(10), 'Also reaches ', more, ' more forbidden module', CASE WHEN more > 1 THEN 's' ELSE '' END,
    CASE WHEN hops IS NULL THEN ' through this import' WHEN hops = 1 THEN concat(', through the import of ', names) ELSE concat(', through the imports of ', names) END, '.') ELSE '' END, chr(10), 'FIX: go through ', substr(src, 12)) AS text
FROM s JOIN n USING (src) LEFT JOIN t USING (src)"""


MISSING_SQL = """WITH c AS (SELECT concat('@/customer/', lower(c_mktsegment), '/c-', c_custkey) AS id, c_mktsegment AS m, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
p AS (SELECT id, 'must transitively import ''@/region/asia''' AS said FROM c WHERE r_name <> 'ASIA' UNION ALL SELECT id, 'must import ''@/nation/*_1*''' FROM c WHERE n_name NOT LIKE '%\\_1%' ESCAPE '\\'
  UNION ALL SELECT id, concat('requires ''@/segment/', upper(m[1]), lower(m[2:]), ''' to exist') FROM c)
SELECT concat('star#customers-in-asia#', id) AS problem_id, concat('# star#customers-in-asia#', id, chr(10), 'asia', chr(10), chr(10), 'Module ''', id, ''' ', said, '.', chr(10), 'FIX: move') AS text FROM p"""

NATIONS = "  - {id: nations, target: '@/nation/{{NATION_NAME}}', description: d, fix: f, uses: [{import: '@/region/asia'}], forbids: [{import: '@/region/e*'}], exists: [{module: '@/nations/{{nation-name}}'}, {module: '@/region/asia'}]}\n"


def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place in the report of every problem that nations have, and how it begins."""
    edges = derived.star(spark, sf_dir).filter("src like '@/nation/%'")
    found = problems.placed(problems.formatted(enforce(*_project(edges), _books(NATIONS))))
    return found.select("place", "problem_id", F.element_at(F.split("text", "\n"), 4).alias("said"))


ORDER_SQL = """WITH n AS (SELECT concat('@/nation/', n_name) AS id, n_name, replace(lower(r_name), ' ', '-') AS r FROM nation JOIN region ON n_regionkey = r_regionkey),
p AS (SELECT id, 0 AS kind, concat('Module ''', id, ''' directly imports ''@/region/', r, '''.') AS said FROM n WHERE starts_with(r, 'e')
  UNION ALL SELECT id, 2, concat('Module ''', id, ''' must import ''@/region/asia''.') FROM n WHERE r <> 'asia'
  UNION ALL SELECT id, 3, concat('Module ''', id, ''' requires ''@/nations/', replace(lower(n_name), '_', '-'), ''' to exist.') FROM n)
SELECT (row_number() OVER (ORDER BY id, kind))::INT AS place, concat('cases#nations#', id) AS problem_id, said FROM p"""


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What runs over as many modules as there are nations say."""
    books, n = _books(NATIONS), table(spark, sf_dir, "nation").count()
    runs = [report.Run("check", n, report.rule_count(books), n, 1), report.Run("baseline", 1, 2), report.Run("fix", n, 3, 2, 2)]
    lines = [report.summary(r, s) for r, s in zip(runs, (0.5, 2.0, 61.25), strict=True)] + report.found(runs[0], "arcweft").split("\n") + [report.found(runs[1], "arcweft").split("\n")[0]]
    lines += [text for _, text in report.banner(books, "arcweft")] + [report.banner([], "arcweft")[0][1].split("\n")[0], report.fixed(n), report.fixed(1), report.fixed(0), str(runs[0].clean), str(runs[2].clean)]
    return spark.createDataFrame(list(enumerate(lines)), "no int, line string")


REPORT_LINES_SQL = """WITH n AS (SELECT count(*) AS n FROM nation) SELECT no::INT AS no, line FROM n, LATERAL (VALUES
  (0, concat('⏱  Checked ', n, ' modules enforcing 3 rules in 500ms')), (1, '⏱  Baselined 1 module enforcing 2 rules in 2.00s'), (2, concat('⏱  Scanned ', n, ' modules in 61.25s')),
  (3, concat('Found ', n, ' problems, 1 of them auto-fixable.')), (4, '   Run `arcweft fix` to fix the 1 auto-fixable problem.'), (5, concat('   Run `arcweft baseline` to silence all ', n, ' problems.')), (6, 'Found 0 problems, none auto-fixable.'),
  (7, '📚 Loaded 1 rulebook, 1 rule'), (8, 'WARNING: No architecture rules loaded. Only the built-in checks run.'), (9, concat('✨ Fixed ', n, ' problems!')), (10, '✨ Fixed 1 problem!'), (11, '✨ The project is already clean!'), (12, 'False'), (13, 'True')) v(no, line)"""

# --- sources ---

#: Source with § for a name, and the targets that its import statements have.
SOURCES = [
    ("import { foo } from '§';", "§"), ("ximport y from '§'", "§"), ("export { a } from '§'", ""), ("require('§')", ""), ("import('§')", "§"), ("import.meta.url === '§'", "§"), ("import(`§`)", ""), ("import a,\n{b} from '§'", ""),
    ("import a from '§' // c\nimport b from 'b'\n", "§"), ("import a from '§'; // c\nimport b from 'b'\n", "§ b"), ('import {\n a,\n b\n} from "§";', "§"), ("// import x from '§'\nimport '§'", "§"), ("/* import x from 'y' */ import z from '§'", "§"),
    ("/* import x from '§'", "§"), ("import ''", ""), ("import '§", "§"), ("import }x from '§'", ""), ("import a from 'it\\'s §'", "it\\"), ("const s = \"import k from '§'\"", "§"), ("import { a } /* } ; */ from \"§\" ;import c from 'c'", "c"),
]


def parse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of odd import statements, and whether the source comes back whole."""
    cases = each(table(spark, sf_dir, "nation").select("n_name"), list(enumerate(t for t, _ in SOURCES)), "no", "source")
    files = cases.select(F.concat_ws("/", "n_name", F.col("no").cast("string")).alias("path"), F.replace("source", F.lit("§"), F.col("n_name")).alias("content"))
    nodes = parse.nodes(files)
    found = nodes.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("ord", "target")))), lambda x: x["target"]), " ").alias("targets"))
    return found.join(parse.rendered(nodes).select("path", F.col("content").alias("_back")), "path").join(files, "path").select("path", "targets", (F.col("content") == F.col("_back")).alias("whole"))


PARSE_EDGES_SQL = f"SELECT concat(n_name, '/', no) AS path, replace(targets, '§', n_name) AS targets, true AS whole FROM nation, {values([(i, t) for i, (_, t) in enumerate(SOURCES)])} v(no, targets)"

CLASSES = "alnum alpha blank cntrl digit graph lower print punct space upper xdigit".split()


def ignored_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-letter names that each of the POSIX classes, or its opposite, takes."""
    letters = spark.range(32, 127).filter("id <> 47").select(F.char("id").alias("c"))
    paths = each(letters, [(s,) for c in CLASSES for s in (c, f"not-{c}")], "s").select(F.concat("s", F.lit("/"), "c").alias("path"), F.lit(False).alias("is_dir"))
    return ignore.ignored(paths, ignore.rules_from(spark, {**{c: f"[[:{c}:]]" for c in CLASSES}, **{f"not-{c}": f"[^[:{c}:]]" for c in CLASSES}}))


IGNORED_CLASSES_SQL = f"""WITH c AS (SELECT chr(i::INT) AS c FROM range(32, 127) r(i) WHERE i <> 47), k AS (SELECT * FROM {values([(c,) for c in CLASSES])} v(k))
SELECT concat(k, '/', c) AS path FROM c, k WHERE regexp_matches(c, concat('^[[:', k, ':]]$')) UNION ALL SELECT concat('not-', k, '/', c) FROM c, k WHERE NOT regexp_matches(c, concat('^[[:', k, ':]]$'))"""

#: Lines of an ignore file; names with § for a key, and whether they are ignored.
LINES = "# comment §\n\\#x*\n\\!y*\nq[0-9]\\ \nr[0-9]*   \nz[\\]]*\n[a-\n  \nu\\*\nk[0-9]*/\nv/**/w*\n!r7*\n"
NAMES = [
    ("# comment §", False), ("#x§", True), ("!y§", True), ("q1 ", True), ("q1", False), ("r§", True), ("z]§", True), ("za§", False), ("[a-", True), ("u*", True), ("ux§", False), ("k§", False), ("k1§/in.ts", True), ("v/w§", True), ("v/a/b/w§", True), ("x/w§", False), ("r7§", False),
]


def ignored_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escapes, trailing spaces, unfinished classes, folders and exceptions."""
    keys = table(spark, sf_dir, "region").select((F.col("r_regionkey") % 5).cast("string").alias("k"))
    paths = each(keys, [(n,) for n, _ in NAMES], "name").select(F.concat(F.lit("s/"), F.replace("name", F.lit("§"), F.col("k"))).alias("path"), F.lit(False).alias("is_dir")).distinct()
    return ignore.ignored(paths, ignore.rules_from(spark, {"s": LINES}))


IGNORED_ESCAPES_SQL = f"SELECT DISTINCT concat('s/', replace(name, '§', (r_regionkey % 5)::VARCHAR)) AS path FROM region, {values(NAMES)} v(name, gone) WHERE gone"

ALIASES = '{"compilerOptions": {"baseUrl": "./", /* several */ "paths": {"@/*": ["src/*"], "@region/*": ["./src/region/*"], "@asia": ["src/region/asia/index", "src/*"], "#n/*-x": ["src/nation/*"], "@both/*": ["none/*", "src/supplier/*"], "bad/*/*": ["src/*"]}}} // end'


def alias_module_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Module ids where several aliases fit: exact ones first, then those with more text."""
    files = derived.sources(spark, sf_dir).select(F.concat(F.lit("/p/"), "path").alias("path"))
    return resolve.module_ids(files, parse_config(ALIASES, "/p"))


_REGION_ID = "CASE WHEN r_name = 'ASIA' THEN '@asia' ELSE concat('@region/', replace(lower(r_name), ' ', '-'), '/index') END"
ALIAS_IDS_SQL = f"""SELECT DISTINCT concat('/p/src/orders/o-', l_orderkey, '.ts') AS path, concat('@/orders/o-', l_orderkey) AS module_id FROM lineitem UNION ALL SELECT concat('/p/src/supplier/s-', s_suppkey, '.ts'), concat('@both/s-', s_suppkey) FROM supplier
UNION ALL SELECT concat('/p/src/nation/', n_name, '.tsx'), concat('#n/', n_name, '-x') FROM nation UNION ALL SELECT concat('/p/src/region/', replace(lower(r_name), ' ', '-'), '/index.ts'), {_REGION_ID} FROM region"""


def alias_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical targets under the same aliases."""
    files = derived.sources(spark, sf_dir)
    return api.analyse(files, "/p", parse_config(ALIASES, "/p"), [], rules=False).imports.select("module_id", "target")


ALIAS_IMPORTS_SQL = f"""SELECT concat('@/orders/o-', l_orderkey) AS module_id, concat('@both/s-', l_suppkey) AS target FROM lineitem
UNION ALL SELECT concat('@both/s-', s_suppkey), concat('#n/', n_name, '-x') FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT concat('#n/', n_name, '-x'), {_REGION_ID} FROM nation JOIN region ON n_regionkey = r_regionkey"""

# --- whole runs ---

RULE = "id: atlas\nname: Atlas\nrules:\n  - {id: no-asia, target: '@/nation/*', description: far, fix: stay, forbids: [{import: '@/region/asia/**'}]}\n"


def _texts(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Files of a project: nations import their regions by relative paths."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", derived.slug("r_name").alias("r")).collect()  # some nations
    texts = {f"src/nation/{x.n_name}.ts": f"import {{ R }} from '../region/{x.r}';\n" for x in rows} | {f"src/region/{x.r}/index.ts": "export const R = 1;\n" for x in rows}
    texts |= {"tsconfig.json": '{"compilerOptions": {"paths": {"@/*": ["src/*"]}}} // end', "arcweft/rules/atlas.yaml": RULE, ".gitignore": "gen/\n", "gen/g.ts": "import '../src/nation/x';"}
    return texts | {"dist/d.ts": "import '../src/nation/x';", "src/readme.md": "import 'x'"}


@contextlib.contextmanager
def _folder(spark: SparkSession, sf_dir: str) -> Iterator[str]:
    """The project in a folder of the driver, which alone reads and writes it, and takes it away after a run."""
    with tempfile.TemporaryDirectory() as folder:
        for path, text in _texts(spark, sf_dir).items():
            write_text(spark, os.path.join(folder, path), text)
        yield folder


def project_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems of a project on disk, in the order of the report."""
    with _folder(spark, sf_dir) as folder:
        rows = [(i, r.problem_id, r.text.split("\n")[-1]) for i, r in enumerate(api.check(spark, folder)[0].collect())]
    return spark.createDataFrame(rows, "place int, problem_id string, fix string")


def project_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by an address in the store that the cluster shares, of which executors read the files."""
    folder = f"{shared_folder(spark)}/project-{uuid.uuid4().hex}"
    for path, text in _texts(spark, sf_dir).items():
        write_text(spark, f"{folder}/{path}", text)
    rows = [(i, r.problem_id, r.text.split("\n")[-1]) for i, r in enumerate(api.check(spark, folder)[0].collect())]
    return spark.createDataFrame(rows, "place int, problem_id string, fix string")


PROJECT_SQL = """WITH n AS (SELECT n_name, replace(lower(r_name), ' ', '-') AS r FROM nation JOIN region ON n_regionkey = r_regionkey),
p AS (SELECT concat('no-relative-imports#src/nation/', n_name, '.ts') AS problem_id, concat('FIX: Use ```import { R } from ''@/region/', r, '/index'';``` instead.') AS fix, 0 AS k, n_name || '.ts' AS o FROM n
  UNION ALL SELECT concat('atlas#no-asia#@/nation/', n_name), 'FIX: stay', 1, n_name FROM n WHERE r = 'asia')
SELECT (row_number() OVER (ORDER BY k, o) - 1)::INT AS place, problem_id, fix FROM p"""


def project_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the files of a project hold after they were fixed."""
    with _folder(spark, sf_dir) as folder:
        changed, _ = api.fix(spark, folder)
        rows = []
        for path in changed:
            with open(path, encoding="utf-8") as f:
                rows.append((os.path.relpath(path, folder), f.read()))
        rows.append(("again", str(len(api.fix(spark, folder)[0]))))
    return spark.createDataFrame(rows, "path string, content string")


FIX_SQL = """SELECT concat('src/nation/', n_name, '.ts') AS path, concat('import { R } from ''@/region/', replace(lower(r_name), ' ', '-'), '/index'';', chr(10)) AS content FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'again', '0'"""


def project_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that a new baseline accepts, as they stand in its file, and how many problems are left."""
    with _folder(spark, sf_dir) as folder:
        api.baseline(spark, folder)
        ids = [r.problem_id for r in api.load_baseline(spark, api.baseline_path(folder)).collect()]
        left = api.check(spark, folder)[1].total
    return spark.createDataFrame([*enumerate(ids), (-1, str(left))], "place int, problem_id string")


BASELINE_SQL = f"SELECT (row_number() OVER (ORDER BY problem_id) - 1)::INT AS place, problem_id FROM ({PROJECT_SQL}) UNION ALL SELECT -1, '0'"


def project_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the command line says about a project, but for times and the folder's name."""
    before, said = os.environ.get("ARCWEFT_TRANSCRIPT"), io.StringIO()
    os.environ["ARCWEFT_TRANSCRIPT"] = "1"
    try:
        with _folder(spark, sf_dir) as folder, contextlib.redirect_stdout(said):
            codes = [cli.main(["check", folder]), cli.main(["baseline", folder]), cli.main(["check", folder])]
    finally:
        os.environ.pop("ARCWEFT_TRANSCRIPT") if before is None else os.environ.update(ARCWEFT_TRANSCRIPT=before)
    lines = [line for line in said.getvalue().split("\n") if line.startswith(("[Success]", "[Error] Found", "[Error] ❌", "[Plain] 📚", "   Run"))]
    return spark.createDataFrame([*enumerate(lines), (-1, str(codes))], "no int, line string")


LOG_SQL = f"""WITH p AS (SELECT count(*) AS n, count(*) FILTER (starts_with(problem_id, 'no-')) AS f FROM ({PROJECT_SQL})) SELECT no::INT AS no, line FROM p, LATERAL (VALUES (0, '[Plain] 📚 Loaded 1 rulebook, 1 rule'), (1, concat('[Error] Found ', n, ' problems:')),
  (2, concat('[Error] ❌ Error: Found ', n, ' problems, ', f, ' of them auto-fixable.')), (3, concat('   Run `arcweft fix` to fix the ', f, ' auto-fixable problems.')), (4, concat('   Run `arcweft baseline` to silence all ', n, ' problems.')),
  (5, '[Plain] 📚 Loaded 1 rulebook, 1 rule'), (6, concat('[Success] ✅ Success: Baseline generated with ', n, ' problems.')), (7, '[Plain] 📚 Loaded 1 rulebook, 1 rule'), (8, '[Success] ✅ Success: No problems found.'), (-1, '[1, 0, 0]')) v(no, line)"""

QUERIES = {
    "rule_spellings": rule_spellings, "rule_most_spellings": rule_most_spellings, "pattern_agreement": pattern_agreement, "casing_decodings": casing_decodings, "pattern_errors": pattern_errors, "near_names": near_names, "rulebook_errors": rulebook_errors,
    "report_transitive": report_transitive, "report_missing": report_missing, "report_order": report_order, "report_lines": report_lines, "parse_edges": parse_edges, "ignored_classes": ignored_classes, "ignored_escapes": ignored_escapes,
    "alias_module_ids": alias_module_ids, "alias_imports": alias_imports, "project_check": project_check, "project_stored": project_stored, "project_fix": project_fix, "project_baseline": project_baseline, "project_log": project_log,
}
SQL = {
    "rule_spellings": SPELLINGS_SQL, "rule_most_spellings": MOST_SQL, "pattern_agreement": AGREEMENT_SQL, "casing_decodings": DECODINGS_SQL, "pattern_errors": ERRORS_SQL, "near_names": NEAR_SQL, "rulebook_errors": RULEBOOK_ERRORS_SQL,
    "report_missing": MISSING_SQL, "report_order": ORDER_SQL, "report_lines": REPORT_LINES_SQL, "parse_edges": PARSE_EDGES_SQL, "ignored_classes": IGNORED_CLASSES_SQL, "ignored_escapes": IGNORED_ESCAPES_SQL,
    "alias_module_ids": ALIAS_IDS_SQL, "alias_imports": ALIAS_IMPORTS_SQL, "project_check": PROJECT_SQL, "project_stored": PROJECT_SQL, "project_fix": FIX_SQL, "project_baseline": BASELINE_SQL, "project_log": LOG_SQL,
}
