"""Built-in checks: imports that have a canonical alias, and import cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweft.operators.graph import loops
from arcweft.operators.problems import LINT, shaped, trim

#: Ids and texts of the checks.
RELATIVE, CYCLES = "no-relative-imports", "no-import-cycles"
RELATIVE_TEXT = "Relative imports are not allowed. Use aliased ones."
CYCLE_TEXT = "Circular dependency (import cycle) detected: "
CYCLE_FIX = "Import cycles are not allowed. Break the loop by removing one of its imports - usually by extracting the shared code into a module that both sides can depend on."


def relative_to(base: str, path: Column) -> Column:
    """The path below the base folder, or the whole path where it is not below."""
    base = "/".join(p for p in base.rstrip("/").split("/") if p != ".")
    return F.when(path.startswith(base + "/"), F.substring(path, len(base) + 2, 2**31 - 1)).otherwise(path)


def relative_imports(nodes: DataFrame, base_url: str, baseline: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Problems of imports whose canonical id differs, and the nodes with targets rewritten.

    `nodes` are parsed nodes with canonical (null where a node is no import). A file in the baseline keeps its targets;
    its problems are reported all the same, suppression comes later.
    """
    file = relative_to(base_url, F.col("path"))
    differs = F.col("target").isNotNull() & (F.col("target") != F.col("canonical"))
    new = F.concat("prefix", "canonical", "suffix")
    problems = nodes.filter(differs).select(
        F.lit(LINT).alias("type_ord"), F.lit(RELATIVE).alias("lint_rule"), file.alias("file"), F.concat("prefix", "target", "suffix").alias("code"), F.lit(RELATIVE_TEXT).alias("description"),
        F.concat(F.lit("Use ```"), new, F.lit("``` instead.")).alias("lint_fix"), F.lit(True).alias("auto_fixable"),
    )
    out = nodes.withColumn("_id", F.concat_ws("#", F.lit(RELATIVE), F.regexp_replace(file, r"\\", "/")))
    if baseline is None:
        out = out.withColumn("_kept", F.lit(False))
    else:
        out = out.join(baseline.select(F.col("problem_id").alias("_id")).distinct().withColumn("_in", F.lit(True)), "_id", "left").withColumn("_kept", F.coalesce("_in", F.lit(False)))
    rewritten = out.withColumn("target", F.when(differs & ~F.col("_kept"), F.col("canonical")).otherwise(F.col("target")))
    return shaped(problems), rewritten.select("path", "ord", "prefix", "target", "suffix", "raw")


def import_cycles(edges: DataFrame, imports: DataFrame, modules: DataFrame, base_url: str) -> DataFrame:
    """A problem for each component of the import graph that has a cycle and consists of modules only.

    `modules` (module_id, path): where files share an id, the last one in walk order speaks for it; code is its first
    import of the next module on the loop.
    """
    found = loops(edges, modules)
    speaks = modules.groupBy("module_id").agg(F.max_by("path", F.split("path", "/")).alias("path"))
    found = found.withColumn("_next", F.coalesce(F.try_element_at("loop", F.lit(2)), F.col("start"))).join(speaks.withColumnRenamed("module_id", "start"), "start")
    first = imports.groupBy("path", F.col("target").alias("_next")).agg(F.min_by("raw_statement", "ord").alias("_raw"))
    found = found.join(first, ["path", "_next"], "left")
    shown = F.concat(F.lit(CYCLE_TEXT), F.array_join(F.array_append("loop", F.col("start")), " → "))
    return shaped(found.select(
        F.lit(LINT).alias("type_ord"), F.lit(CYCLES).alias("lint_rule"), relative_to(base_url, F.col("path")).alias("file"), F.coalesce(trim(F.col("_raw")), F.col("_next")).alias("code"), shown.alias("description"),
        F.lit(CYCLE_FIX).alias("lint_fix"), F.lit(False).alias("auto_fixable"),
    ))
