"""Findings as rows: one wide schema, suppression by a baseline, compaction, order, counts and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Order of the two types and of the kinds of rule problems.
LINT, RULE = 0, 1
DIRECT, TRANSITIVE, MISSING_USE, MISSING_MODULE = 0, 1, 2, 3

#: Columns in the order that findings are sorted by; `seq` only breaks ties between equal chains of one id.
_STRING, _CHAIN = T.StringType(), T.ArrayType(T.StringType())
_TYPES = {
    "type_ord": T.IntegerType(), "problem_id": _STRING, "lint_rule": _STRING, "file": _STRING, "code": _STRING, "description": _STRING, "lint_fix": _STRING, "auto_fixable": T.BooleanType(),
    "rulebook_id": _STRING, "rule_id": _STRING, "bad_module": _STRING, "prose": _STRING, "kind_ord": T.IntegerType(), "imported": _STRING, "import_statement": _STRING, "chain": _CHAIN, "first_import": _STRING,
    "also_reached": T.ArrayType(_CHAIN), "required_import": _STRING, "transitive": T.BooleanType(), "required_module": _STRING, "rule_fix": _STRING, "seq": T.ArrayType(T.IntegerType()),
}
SCHEMA = T.StructType([T.StructField(n, t) for n, t in _TYPES.items()])
ORDER = [f.name for f in SCHEMA if f.name not in ("problem_id", "seq")]


def trim(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def shaped(rows: DataFrame) -> DataFrame:
    """Rows with some of the columns as rows with all of them; the id is made up where it is missing."""
    lint_id = F.concat_ws("#", "lint_rule", F.regexp_replace("file", r"\\", "/")) if "lint_rule" in rows.columns else None
    rule_id = F.concat_ws("#", "rulebook_id", "rule_id", "bad_module") if "rule_id" in rows.columns else None
    if "problem_id" not in rows.columns:
        rows = rows.withColumn("problem_id", lint_id if lint_id is not None else rule_id)
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMA])


def none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def suppressed(problems: DataFrame, baseline: DataFrame | None) -> DataFrame:
    """Problems whose id is not in `baseline` (problem_id)."""
    return problems if baseline is None else problems.join(baseline.select("problem_id").distinct(), "problem_id", "left_anti").select(problems.columns)


def compacted(problems: DataFrame) -> DataFrame:
    """Transitive imports of one id become one problem: the shortest chain stays and takes the others' chains along.

    Chains stand by length, then ids; equal ones by the rule and clause that found them. Everything else stays as it is.
    Doing it twice changes nothing.
    """
    is_chain = (F.col("type_ord") == RULE) & (F.col("kind_ord") == TRANSITIVE)
    kept = problems.filter(~F.coalesce(is_chain, F.lit(False)))
    fields = [c for c in problems.columns if c not in ("chain", "seq")]
    first = F.min(F.struct(F.size("chain").alias("_n"), "chain", "seq", *fields))
    entry = F.struct(F.size("chain").alias("_n"), "chain", "seq", "also_reached")  # all that the others leave behind
    groups = problems.filter(is_chain).groupBy(F.col("problem_id").alias("_id")).agg(first.alias("_one"), F.array_sort(F.collect_list(entry)).alias("_all"))
    empty = F.array().cast("array<array<string>>")
    others = F.flatten(F.transform(F.slice("_all", F.lit(2), F.size("_all")), lambda e: F.concat(F.array(e["chain"]), F.coalesce(e["also_reached"], empty))))
    one = groups.select("_one", others.alias("_others"))
    return kept.unionByName(one.select(*[(F.concat(F.coalesce("_one.also_reached", empty), "_others") if c == "also_reached" else F.col(f"_one.{c}")).alias(c) for c in problems.columns]))


def ordered(problems: DataFrame) -> DataFrame:
    """In the order of a report: by all columns, nulls first, arrays element by element."""
    return problems.orderBy(*[F.col(c).asc_nulls_first() for c in ORDER])


def placed(problems: DataFrame) -> DataFrame:
    """`problems` with their place in that order, from 1: for reports, which are read from the first to the last."""
    return problems.withColumn("place", F.row_number().over(Window.orderBy(*[F.col(c).asc_nulls_first() for c in ORDER])))


def baseline_ids(problems: DataFrame) -> DataFrame:
    """(problem_id), sorted, each once."""
    return problems.select("problem_id").distinct().orderBy("problem_id")


def counts(problems: DataFrame) -> DataFrame:
    """(total, auto_fixable): one row."""
    return problems.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce("auto_fixable", F.lit(False))).alias("auto_fixable"))


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, F.lit(f" {word}")).otherwise(F.lit(f" {word}s")))


def text_of() -> Column:
    """A problem as readers see it."""
    fence = lambda code: F.concat(F.lit("\n```ts\n"), code, F.lit("\n```"))
    lint = F.concat(
        F.when(F.col("auto_fixable"), "[AUTO-FIXABLE] ").otherwise(""), F.lit("# "), "problem_id", F.lit("\n"), "description",
        fence(trim(F.col("code"))), F.lit("\nFIX: "), trim(F.coalesce("lint_fix", F.lit(""))),
    )
    chain, more = F.col("chain"), F.coalesce("also_reached", F.array().cast("array<array<string>>"))
    shown = F.try_element_at(chain, F.lit(2))
    hops = F.array_distinct(F.filter(F.transform(more, lambda c: F.try_element_at(c, F.lit(2))), lambda h: h.isNotNull() & ~h.eqNullSafe(shown)))
    through = (
        F.when(F.size(hops) == 0, F.lit(" through this import"))
        .when(F.size(hops) == 1, F.concat(F.lit(", through the import of '"), F.try_element_at(hops, F.lit(1)), F.lit("'")))
        .otherwise(F.concat(F.lit(", through the imports of '"), F.array_join(hops, "', '"), F.lit("'")))
    )
    also = F.when(F.size(more) > 0, F.concat(F.lit("\nAlso reaches "), plural(F.size(more), "more forbidden module"), through, F.lit("."))).otherwise("")
    module = F.concat(F.lit("Module '"), "bad_module", F.lit("' "))
    said = (
        F.when(F.col("kind_ord") == DIRECT, F.concat(module, F.lit("directly imports '"), "imported", F.lit("'."), fence(F.col("import_statement"))))
        .when(
            F.col("kind_ord") == TRANSITIVE,
            F.concat(
                module, F.lit("transitively imports '"), F.coalesce(F.try_element_at(chain, F.lit(-1)), F.lit("")), F.lit("' ("), plural(F.greatest(F.size(chain) - 1, F.lit(0)), "hop"),
                F.lit(") via: "), F.array_join(chain, " → "), F.lit("."), F.coalesce(fence(F.col("first_import")), F.lit("")), also,
            ),
        )
        .when(F.col("kind_ord") == MISSING_USE, F.concat(module, F.lit("must "), F.when(F.col("transitive"), "transitively ").otherwise(""), F.lit("import '"), "required_import", F.lit("'.")))
        .when(F.col("kind_ord") == MISSING_MODULE, F.concat(module, F.lit("requires '"), "required_module", F.lit("' to exist.")))
    )
    rule = F.concat(F.lit("# "), "problem_id", F.lit("\n"), "prose", F.lit("\n\n"), said, F.lit("\nFIX: "), trim(F.col("rule_fix")))
    return F.when(F.col("type_ord") == LINT, lint).otherwise(rule)


def formatted(problems: DataFrame) -> DataFrame:
    """`problems` with text."""
    return problems.withColumn("text", text_of())
