"""Queries over the bundled tables, one or more for each group of operators, with DuckDB SQL that computes the same.

Graphs and sources are derived from whole tables (`arcweft.plans.derived`); the SQL derives them on its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweft import api, queries_cases
from arcweft.functions.casing import Casing, spelled_in, words_of, written
from arcweft.operators import graph, lints, parse, problems, resolve
from arcweft.operators.enforce import Ruleset, enforce, matches
from arcweft.plans import derived
from arcweft.plans.derived import table
from arcweft.plans.rulebooks import Rulebook, read_rulebooks
from arcweft.sources import ignore
from arcweft.sources.aliases import parse_config

STAR_SQL = """
lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS nth FROM lineitem),
star AS (
  SELECT concat('@/orders/o-', o.o_orderkey) AS src, concat('@/customer/', lower(c.c_mktsegment), '/c-', c.c_custkey) AS dst, 0 AS ord FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  UNION ALL SELECT concat('@/orders/o-', l_orderkey), concat('@/part/p-', l_partkey), 2 * nth + 1 FROM lines
  UNION ALL SELECT concat('@/orders/o-', l_orderkey), concat('@/supplier/s-', l_suppkey), 2 * nth + 2 FROM lines
  UNION ALL SELECT concat('@/customer/', lower(c_mktsegment), '/c-', c_custkey), concat('@/nation/', n_name), 0 FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT concat('@/supplier/s-', s_suppkey), concat('@/nation/', n_name), 0 FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT concat('@/nation/', n_name), concat('@/region/', replace(lower(r_name), ' ', '-')), 0 FROM nation JOIN region ON n_regionkey = r_regionkey),
step AS (SELECT src, dst, min(ord) AS ord FROM star GROUP BY src, dst)"""
#: Every chain of the star has at most three hops; of equally long ones the first in import order counts.
CHAINS_SQL = STAR_SQL + """,
chains AS (
  SELECT src, dst, [ord] AS ords, [src, dst] AS chain FROM step
  UNION ALL SELECT a.src, b.dst, [a.ord, b.ord], [a.src, a.dst, b.dst] FROM step a JOIN step b ON a.dst = b.src
  UNION ALL SELECT a.src, c.dst, [a.ord, b.ord, c.ord], [a.src, a.dst, b.dst, c.dst] FROM step a JOIN step b ON a.dst = b.src JOIN step c ON b.dst = c.src),
short AS (SELECT * FROM chains QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY len(ords), ords) = 1)"""
FLOW_SQL = """
flow AS (
  SELECT src, dst, min(event_id) AS ord FROM (
    SELECT concat('@/u', user_id, '/', event_type) AS src, event_id, concat('@/u', user_id, '/', lead(event_type) OVER w) AS dst, lead(event_type) OVER w AS nxt
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) q WHERE nxt IS NOT NULL GROUP BY src, dst),
reach AS (SELECT src, dst FROM flow UNION SELECT r.src, f.dst FROM reach r JOIN flow f ON r.dst = f.src),
comp AS (SELECT a.src AS id, min(a.dst) AS component FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src)"""

RULES = """
id: star
name: Star schema
rules:
  - id: orders-know-no-region
    description: "{{TARGET_DIR}} stands above regions"
    target: "@/orders/o-{{order-key}}"
    forbids: [{import: "@/region/**", transitive: "true"}]
    fix: " go through {{order-key}} "
  - id: orders-use-few-parts
    description: parts
    target: "@/orders/**"
    exclude: ["@/orders/*7"]
    forbids: [{import: "@/part/*"}]
    allows: [{import: "@/part/p-1*"}]
    fix: less
  - id: customers-in-asia
    description: asia
    target: "@/customer/{{market-segment}}/**"
    uses: [{import: "@/region/asia", transitive: "true"}, {import: "@/nation/*_1*"}]
    exists: [{module: "{{TARGET_DIR}}/../../segment/{{MarketSegment}}"}, {module: "@/nation/NATION_3"}]
    fix: move
"""


def _rules(*ids: str) -> list[Rulebook]:
    (book,) = read_rulebooks([("star.yaml", RULES)])
    return [Rulebook(book.id, book.name, book.description, tuple(r for r in book.rules if r.id in ids))]


def _enforced(spark: SparkSession, sf_dir: str, *ids: str) -> DataFrame:
    edges = derived.star(spark, sf_dir)
    modules, imports = derived.as_project(edges)
    return enforce(modules, imports, edges, graph.vertices_of(edges, modules), _rules(*ids))


# --- graph ---


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, imports = derived.as_project(derived.star(spark, sf_dir))
    return graph.edges_of(imports)


EDGES_SQL = f"WITH {STAR_SQL} SELECT src, dst, (row_number() OVER (PARTITION BY src ORDER BY ord) - 1)::INT AS ord FROM star"


def graph_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = derived.star(spark, sf_dir)
    return graph.vertices_of(edges, derived.as_project(edges)[0])


VERTICES_SQL = f"WITH {STAR_SQL} SELECT id, bool_and(external) AS is_external FROM (SELECT src AS id, false AS external FROM star UNION ALL SELECT dst, true FROM star) q GROUP BY id"


def graph_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = derived.star(spark, sf_dir)
    return graph.distances(edges, edges.select("src"))


REACHABLE_SQL = f"WITH {CHAINS_SQL} SELECT src, dst, len(ords)::INT AS hops FROM short UNION ALL SELECT DISTINCT src, src, 0 FROM star"


def graph_shortest_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = derived.star(spark, sf_dir)
    regions = [r.dst for r in table(spark, sf_dir, "region").select(F.concat(F.lit("@/region/"), derived.slug("r_name")).alias("dst")).collect()]
    pairs = edges.select("src").distinct().select("src", F.explode(F.array(*map(F.lit, regions))).alias("dst"))
    return graph.shortest_chain(edges, pairs).select("src", "dst", F.array_join("chain", " > ").alias("chain"))


CHAIN_SQL = f"WITH {CHAINS_SQL} SELECT src, dst, array_to_string(chain, ' > ') AS chain FROM short WHERE starts_with(dst, '@/region/')"


def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = derived.flow(spark, sf_dir)
    ids = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    return graph.strong_components(edges, ids)


COMPONENTS_SQL = f"""WITH RECURSIVE {FLOW_SQL}
SELECT v.id, coalesce(c.component, v.id) AS component FROM (SELECT src AS id FROM flow UNION SELECT dst FROM flow) v LEFT JOIN comp c ON v.id = c.id"""


def graph_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.loops(derived.flow(spark, sf_dir)).select("start", F.array_join("loop", " > ").alias("loop"))


LOOPS_SQL = f"""WITH RECURSIVE {FLOW_SQL},
inner_ AS (SELECT f.src, f.dst, a.component AS start FROM flow f JOIN comp a ON f.src = a.id JOIN comp b ON f.dst = b.id AND a.component = b.component),
walks AS (SELECT DISTINCT start, start AS at, [start] AS walk FROM inner_
  UNION SELECT w.start, i.dst, list_append(w.walk, i.dst) FROM walks w JOIN inner_ i ON w.start = i.start AND w.at = i.src WHERE NOT list_contains(w.walk, i.dst))
SELECT w.start, array_to_string(w.walk, ' > ') AS loop FROM walks w JOIN inner_ i ON i.start = w.start AND i.src = w.at AND i.dst = w.start
QUALIFY row_number() OVER (PARTITION BY w.start ORDER BY len(w.walk), w.walk) = 1"""


# --- rules ---


def rule_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    modules = derived.as_project(derived.star(spark, sf_dir))[0]
    found = matches(modules, Ruleset.of(_rules("customers-in-asia")))
    segment = F.col("variables")["market-segment"]
    return found.select("module_id", "target_dir", *[segment[c].alias(c) for c in ("pascal", "camel", "constant", "kebab")])


TARGETS_SQL = """SELECT DISTINCT concat('@/customer/', lower(c_mktsegment), '/c-', c_custkey) AS module_id, concat('@/customer/', lower(c_mktsegment)) AS target_dir,
  concat(upper(c_mktsegment[1]), lower(c_mktsegment[2:])) AS pascal, lower(c_mktsegment) AS camel, upper(c_mktsegment) AS constant, lower(c_mktsegment) AS kebab FROM customer JOIN nation ON c_nationkey = n_nationkey"""


def rule_forbids_transitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _enforced(spark, sf_dir, "orders-know-no-region")
    return found.select("problem_id", "prose", "rule_fix", F.array_join("chain", " > ").alias("chain"), "first_import")


TRANSITIVE_SQL = f"""WITH {CHAINS_SQL} SELECT concat('star#orders-know-no-region#', src) AS problem_id, '@/orders stands above regions' AS prose, concat(' go through ', substr(src, 12), ' ') AS rule_fix,
  array_to_string(chain, ' > ') AS chain, concat('import x from ''', chain[2], ''';') AS first_import FROM short WHERE starts_with(src, '@/orders/') AND starts_with(dst, '@/region/')"""


def rule_forbids_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _enforced(spark, sf_dir, "orders-use-few-parts").select("bad_module", "imported", "import_statement")


DIRECT_SQL = """SELECT concat('@/orders/o-', l_orderkey) AS bad_module, concat('@/part/p-', l_partkey) AS imported, concat('import x from ''@/part/p-', l_partkey, ''';') AS import_statement
FROM lineitem WHERE l_orderkey % 10 <> 7 AND l_partkey::VARCHAR NOT LIKE '1%'"""


def rule_uses_and_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _enforced(spark, sf_dir, "customers-in-asia").select("bad_module", "kind_ord", "required_import", "transitive", "required_module")


USES_SQL = """WITH c AS (SELECT concat('@/customer/', lower(c_mktsegment), '/c-', c_custkey) AS id, c_mktsegment AS m, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT id AS bad_module, 2::INT AS kind_ord, '@/region/asia' AS required_import, true AS transitive, NULL::VARCHAR AS required_module FROM c WHERE r_name <> 'ASIA'
UNION ALL SELECT id, 2, '@/nation/*_1*', false, NULL FROM c WHERE n_name NOT LIKE '%\\_1%' ESCAPE '\\'
UNION ALL SELECT id, 3, NULL, NULL, concat('@/segment/', upper(m[1]), lower(m[2:])) FROM c"""


def problems_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = problems.compacted(_enforced(spark, sf_dir, "orders-know-no-region"))
    return found.select("problem_id", F.array_join("chain", " > ").alias("chain"), F.array_join(F.transform("also_reached", lambda c: F.array_join(c, " > ")), "; ").alias("also_reached"))


COMPACTED_SQL = f"""WITH {CHAINS_SQL}, v AS (SELECT concat('star#orders-know-no-region#', src) AS problem_id, chain, row_number() OVER (PARTITION BY src ORDER BY len(chain), chain) AS k
  FROM short WHERE starts_with(src, '@/orders/') AND starts_with(dst, '@/region/'))
SELECT problem_id, max(array_to_string(chain, ' > ')) FILTER (k = 1) AS chain, coalesce(string_agg(array_to_string(chain, ' > '), '; ' ORDER BY k) FILTER (k > 1), '') AS also_reached FROM v GROUP BY problem_id"""


def problems_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of the direct problems that a baseline of orders of one priority leaves."""
    accepted = table(spark, sf_dir, "orders").filter("o_orderpriority = '5-LOW'").select(F.concat(F.lit("star#orders-use-few-parts#@/orders/o-"), "o_orderkey").alias("problem_id"))
    left = problems.suppressed(_enforced(spark, sf_dir, "orders-use-few-parts"), accepted)
    return problems.formatted(left).select("problem_id", "text")


REPORT_SQL = """SELECT concat('star#orders-use-few-parts#@/orders/o-', l_orderkey) AS problem_id, concat('# star#orders-use-few-parts#@/orders/o-', l_orderkey, chr(10), 'parts', chr(10), chr(10),
  'Module ''@/orders/o-', l_orderkey, ''' directly imports ''@/part/p-', l_partkey, '''.', chr(10), '```ts', chr(10), 'import x from ''@/part/p-', l_partkey, ''';', chr(10), '```', chr(10), 'FIX: less') AS text
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey % 10 <> 7 AND l_partkey::VARCHAR NOT LIKE '1%' AND o_orderpriority <> '5-LOW'"""


def problems_baseline_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return problems.baseline_ids(_enforced(spark, sf_dir, "orders-use-few-parts"))


BASELINE_SQL = """SELECT DISTINCT concat('star#orders-use-few-parts#@/orders/o-', l_orderkey) AS problem_id FROM lineitem WHERE l_orderkey % 10 <> 7 AND l_partkey::VARCHAR NOT LIKE '1%'"""


def problems_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return problems.counts(_enforced(spark, sf_dir, "orders-use-few-parts", "customers-in-asia"))


COUNTS_SQL = f"SELECT (SELECT count(*) FROM ({DIRECT_SQL}) d) + (SELECT count(*) FROM ({USES_SQL}) u) AS total, 0::BIGINT AS auto_fixable"


# --- sources ---

CONFIG = '{ // aliases\n "compilerOptions": { "baseUrl": ".", "paths": { "@/*": ["./src/*"] } } }'
ROOT = "/p"


def _analysis(spark: SparkSession, sf_dir: str) -> api.Analysis:
    return api.analyse(derived.sources(spark, sf_dir), ROOT, parse_config(CONFIG, ROOT), [], rules=False)


def parse_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.imports(parse.nodes(derived.sources(spark, sf_dir))).select("path", "target", "raw_statement")


IMPORTS_SQL = """SELECT concat('src/orders/o-', l_orderkey, '.ts') AS path, concat('../supplier/s-', l_suppkey) AS target, concat('import { P', l_partkey, ' } from ''../supplier/s-', l_suppkey, ''';') AS raw_statement FROM lineitem
UNION ALL SELECT concat('src/supplier/s-', s_suppkey, '.ts'), concat('@/nation/', n_name), concat('import n from "@/nation/', n_name, '"', chr(10)) FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT concat('src/nation/', n_name, '.tsx'), concat('../region/', replace(lower(r_name), ' ', '-')), concat('import { R } from ''../region/', replace(lower(r_name), ' ', '-'), ''';') FROM nation JOIN region ON n_regionkey = r_regionkey"""


def parse_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.rendered(parse.nodes(derived.sources(spark, sf_dir))).select("path", F.md5("content").alias("digest"))


ROUND_TRIP_SQL = """SELECT concat('src/orders/o-', l_orderkey, '.ts') AS path, md5(concat(string_agg(concat('import { P', l_partkey, ' } from ''../supplier/s-', l_suppkey, ''';', chr(10)), '' ORDER BY l_linenumber, l_partkey, l_suppkey), 'export const x = 1;', chr(10))) AS digest FROM lineitem GROUP BY l_orderkey
UNION ALL SELECT concat('src/supplier/s-', s_suppkey, '.ts'), md5(concat('// supplier', chr(10), 'import n from "@/nation/', n_name, '"', chr(10))) FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT concat('src/nation/', n_name, '.tsx'), md5(concat('import { R } from ''../region/', replace(lower(r_name), ' ', '-'), ''';')) FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT concat('src/region/', replace(lower(r_name), ' ', '-'), '/index.ts'), md5('') FROM region"""


def resolve_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Module, and the canonical target of each import after relative ones are rewritten."""
    return _analysis(spark, sf_dir).imports.select("module_id", "target")


RESOLVE_SQL = """SELECT concat('@/orders/o-', l_orderkey) AS module_id, concat('@/supplier/s-', l_suppkey) AS target FROM lineitem
UNION ALL SELECT concat('@/supplier/s-', s_suppkey), concat('@/nation/', n_name) FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT concat('@/nation/', n_name), concat('@/region/', replace(lower(r_name), ' ', '-'), '/index') FROM nation JOIN region ON n_regionkey = r_regionkey"""


def resolve_module_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = derived.sources(spark, sf_dir).select(F.concat(F.lit(f"{ROOT}/"), "path").alias("path"))
    return resolve.module_ids(files, parse_config(CONFIG, ROOT))


MODULE_IDS_SQL = """SELECT concat('/p/', path) AS path, concat('@/', regexp_replace(substr(path, 5), '\\.tsx?$', '')) AS module_id FROM (
  SELECT DISTINCT concat('src/orders/o-', l_orderkey, '.ts') AS path FROM lineitem UNION ALL SELECT concat('src/supplier/s-', s_suppkey, '.ts') FROM supplier
  UNION ALL SELECT concat('src/nation/', n_name, '.tsx') FROM nation UNION ALL SELECT concat('src/region/', replace(lower(r_name), ' ', '-'), '/index.ts') FROM region) q"""


def lint_relative_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir).found.select("problem_id", "code", "lint_fix", "auto_fixable")


LINT_SQL = """SELECT concat('no-relative-imports#src/orders/o-', l_orderkey, '.ts') AS problem_id, concat('import { P', l_partkey, ' } from ''../supplier/s-', l_suppkey, ''';') AS code,
  concat('Use ```import { P', l_partkey, ' } from ''@/supplier/s-', l_suppkey, ''';``` instead.') AS lint_fix, true AS auto_fixable FROM lineitem
UNION ALL SELECT concat('no-relative-imports#src/nation/', n_name, '.tsx'), concat('import { R } from ''../region/', replace(lower(r_name), ' ', '-'), ''';'),
  concat('Use ```import { R } from ''@/region/', replace(lower(r_name), ' ', '-'), '/index'';``` instead.'), true FROM nation JOIN region ON n_regionkey = r_regionkey"""


def fix_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = derived.sources(spark, sf_dir)
    return api.rewrites(_analysis(spark, sf_dir), files, ROOT).select("path", F.md5("content").alias("digest"))


REWRITES_SQL = """SELECT concat('/p/src/orders/o-', l_orderkey, '.ts') AS path, md5(concat(string_agg(concat('import { P', l_partkey, ' } from ''@/supplier/s-', l_suppkey, ''';', chr(10)), '' ORDER BY l_linenumber, l_partkey, l_suppkey), 'export const x = 1;', chr(10))) AS digest FROM lineitem GROUP BY l_orderkey
UNION ALL SELECT concat('/p/src/nation/', n_name, '.tsx'), md5(concat('import { R } from ''@/region/', replace(lower(r_name), ' ', '-'), '/index'';')) FROM nation JOIN region ON n_regionkey = r_regionkey"""


def lint_import_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = derived.flow(spark, sf_dir)
    modules, imports = derived.as_project(edges)
    return lints.import_cycles(edges, imports, modules, "/p").select("problem_id", "description", "code")


CYCLES_SQL = f"""WITH RECURSIVE {FLOW_SQL},
foreign_ AS (SELECT DISTINCT component FROM comp WHERE id NOT IN (SELECT src FROM flow)),
inner_ AS (SELECT f.src, f.dst, a.component AS start FROM flow f JOIN comp a ON f.src = a.id JOIN comp b ON f.dst = b.id AND a.component = b.component WHERE a.component NOT IN (SELECT component FROM foreign_)),
walks AS (SELECT DISTINCT start, start AS at, [start] AS walk FROM inner_
  UNION SELECT w.start, i.dst, list_append(w.walk, i.dst) FROM walks w JOIN inner_ i ON w.start = i.start AND w.at = i.src WHERE NOT list_contains(w.walk, i.dst)),
best AS (SELECT w.start, w.walk FROM walks w JOIN inner_ i ON i.start = w.start AND i.src = w.at AND i.dst = w.start QUALIFY row_number() OVER (PARTITION BY w.start ORDER BY len(w.walk), w.walk) = 1)
SELECT concat('no-import-cycles#src', substr(start, 2), '.ts') AS problem_id, concat('Circular dependency (import cycle) detected: ', array_to_string(list_append(walk, start), ' → ')) AS description,
  concat('import x from ''', coalesce(walk[2], start), ''';') AS code FROM best"""

IGNORE = {"": "*.tmp\n/generated/\n!keep.tmp\nsrc/**/ring-[0-4]/\n", "src/economy": "# standard goes\np-?.ts\n!p-7.ts\n"}


def ignored_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of a path per part are ignored."""
    part = table(spark, sf_dir, "part")
    ending = F.when(F.col("p_partkey") % 11 == 0, ".tmp").otherwise(".ts")
    folder = F.when(F.col("p_partkey") % 13 == 0, "dist").otherwise(F.concat(F.lit("ring-"), F.col("p_size") % 10))
    path = F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/"), folder, F.lit("/p-"), "p_partkey", ending)
    return ignore.ignored(part.select(path.alias("path"), F.lit(False).alias("is_dir")), ignore.rules_from(spark, IGNORE))


IGNORED_SQL = """WITH p AS (SELECT p_partkey AS k, p_size % 10 AS s, lower(p_type) AS t, CASE WHEN p_partkey % 11 = 0 THEN '.tmp' ELSE '.ts' END AS e, CASE WHEN p_partkey % 13 = 0 THEN 'dist' ELSE concat('ring-', p_size % 10) END AS f FROM part)
SELECT concat('src/', t, '/', f, '/p-', k, e) AS path FROM p WHERE f = 'dist' OR s <= 4 OR e = '.tmp' OR (t = 'economy' AND e = '.ts' AND k < 10 AND k <> 7)"""


# --- names ---


def casing_of_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    name = words_of(Casing.CONSTANT, F.col("name"))
    forms = {c.name.lower(): written(c, name) for c in (Casing.PASCAL, Casing.CAMEL, Casing.KEBAB)}
    return nation.select("name", F.array_join(name, ",").alias("words"), *[f.alias(c) for c, f in forms.items()], spelled_in(Casing.CONSTANT, F.col("name")).alias("is_constant"), spelled_in(Casing.KEBAB, F.col("name")).alias("is_kebab"))


CASING_SQL = """SELECT n_name AS name, replace(lower(n_name), '_', ',') AS words, replace(concat(upper(n_name[1]), lower(n_name[2:])), '_', '') AS pascal, replace(lower(n_name), '_', '') AS camel,
  replace(lower(n_name), '_', '-') AS kebab, true AS is_constant, false AS is_kebab FROM nation"""


def casing_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of run-together names of customers' segments and regions."""
    names = table(spark, sf_dir, "customer").select(F.concat(F.initcap("c_mktsegment"), F.lit("No"), "c_nationkey").alias("name")).distinct()
    return names.select("name", F.array_join(words_of(Casing.PASCAL, F.col("name")), ",").alias("words"))


READINGS_SQL = """SELECT DISTINCT concat(upper(c_mktsegment[1]), lower(c_mktsegment[2:]), 'No', c_nationkey) AS name, concat(lower(c_mktsegment), ',no', c_nationkey) AS words FROM customer"""


QUERIES = {
    "graph_edges": graph_edges, "graph_vertices": graph_vertices, "graph_reachable": graph_reachable, "graph_shortest_chain": graph_shortest_chain, "graph_components": graph_components, "graph_loops": graph_loops,
    "rule_targets": rule_targets, "rule_forbids_transitive": rule_forbids_transitive, "rule_forbids_direct": rule_forbids_direct, "rule_uses_and_exists": rule_uses_and_exists,
    "problems_compacted": problems_compacted, "problems_report": problems_report, "problems_baseline_ids": problems_baseline_ids, "problems_counts": problems_counts,
    "parse_imports": parse_imports, "parse_round_trip": parse_round_trip, "resolve_imports": resolve_imports, "resolve_module_ids": resolve_module_ids, "lint_relative_imports": lint_relative_imports,
    "lint_import_cycles": lint_import_cycles, "fix_rewrites": fix_rewrites, "ignored_paths": ignored_paths, "casing_of_names": casing_of_names, "casing_readings": casing_readings,
} | queries_cases.QUERIES
SQL = {
    "graph_edges": EDGES_SQL, "graph_vertices": VERTICES_SQL, "graph_reachable": REACHABLE_SQL, "graph_shortest_chain": CHAIN_SQL, "graph_components": COMPONENTS_SQL, "graph_loops": LOOPS_SQL,
    "rule_targets": TARGETS_SQL, "rule_forbids_transitive": TRANSITIVE_SQL, "rule_forbids_direct": DIRECT_SQL, "rule_uses_and_exists": USES_SQL,
    "problems_compacted": COMPACTED_SQL, "problems_report": REPORT_SQL, "problems_baseline_ids": BASELINE_SQL, "problems_counts": COUNTS_SQL,
    "parse_imports": IMPORTS_SQL, "parse_round_trip": ROUND_TRIP_SQL, "resolve_imports": RESOLVE_SQL, "resolve_module_ids": MODULE_IDS_SQL, "lint_relative_imports": LINT_SQL,
    "lint_import_cycles": CYCLES_SQL, "fix_rewrites": REWRITES_SQL, "ignored_paths": IGNORED_SQL, "casing_of_names": CASING_SQL, "casing_readings": READINGS_SQL, "report_transitive": queries_cases.report_transitive_sql(CHAINS_SQL),
} | queries_cases.SQL
