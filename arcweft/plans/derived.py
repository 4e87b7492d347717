"""Graphs and sources that the bundled queries derive from relational tables, where no project is at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slug(name: str) -> F.Column:
    return F.regexp_replace(F.lower(name), " ", "-")


def star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, ord): orders import their customer, parts and suppliers; those import nations, nations regions. No cycles."""
    t = lambda n: table(spark, sf_dir, n)
    order = lambda key: F.concat(F.lit("@/orders/o-"), key)
    customer = F.concat(F.lit("@/customer/"), F.lower("c_mktsegment"), F.lit("/c-"), "c_custkey")
    nation = F.concat(F.lit("@/nation/"), "n_name")
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))  # line numbers repeat
    lines, zero = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", nth.alias("nth")), F.lit(0).alias("ord")
    parts = [
        t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(order("o_orderkey").alias("src"), customer.alias("dst"), zero),
        lines.select(order("l_orderkey").alias("src"), F.concat(F.lit("@/part/p-"), "l_partkey").alias("dst"), (2 * F.col("nth") + 1).cast("int").alias("ord")),
        lines.select(order("l_orderkey").alias("src"), F.concat(F.lit("@/supplier/s-"), "l_suppkey").alias("dst"), (2 * F.col("nth") + 2).cast("int").alias("ord")),
        t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(customer.alias("src"), nation.alias("dst"), zero),
        t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("@/supplier/s-"), "s_suppkey").alias("src"), nation.alias("dst"), zero),
        t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(nation.alias("src"), F.concat(F.lit("@/region/"), slug("r_name")).alias("dst"), zero),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, ord): the kinds of a user's events import the kinds that came next. Full of cycles."""
    events = table(spark, sf_dir, "events")
    following = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    step = events.select("user_id", "event_type", "event_id", following.alias("next")).filter("next is not null")
    vertex = lambda kind: F.concat(F.lit("@/u"), "user_id", F.lit("/"), kind)
    return step.groupBy(vertex("event_type").alias("src"), vertex("next").alias("dst")).agg(F.min("event_id").cast("int").alias("ord"))


def as_project(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """modules (module_id, path) and imports (module_id, path, ord, target, raw_statement) that have these edges."""
    path = lambda c: F.concat(F.when(F.startswith(c, F.lit("@")), F.concat(F.lit("/p/src"), F.substring(c, 2, 2**31 - 1))).otherwise(c), F.lit(".ts"))
    imports = edges.select(F.col("src").alias("module_id"), path(F.col("src")).alias("path"), "ord", F.col("dst").alias("target"), F.concat(F.lit(" import x from '"), "dst", F.lit("'; ")).alias("raw_statement"))
    modules = edges.select(F.col("src").alias("module_id")).distinct()  # a path is a function of the id, and written after
    return modules.select("module_id", path(F.col("module_id")).alias("path")), imports


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, is_dir, content): TypeScript of orders, suppliers, nations and regions that import each other by relative paths."""
    t = lambda n: table(spark, sf_dir, n)
    line = F.concat(F.lit("import { P"), "l_partkey", F.lit(" } from '../supplier/s-"), "l_suppkey", F.lit("';\n"))
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", line.alias("text"))))
    orders = t("lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(lines, lambda x: x["text"]), "").alias("content"))
    files = [
        orders.select(F.concat(F.lit("src/orders/o-"), "l_orderkey", F.lit(".ts")).alias("path"), F.concat("content", F.lit("export const x = 1;\n")).alias("content")),
        t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("src/supplier/s-"), "s_suppkey", F.lit(".ts")).alias("path"), F.concat(F.lit("// supplier\nimport n from \"@/nation/"), "n_name", F.lit("\"\n")).alias("content")),
        t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("src/nation/"), "n_name", F.lit(".tsx")).alias("path"), F.concat(F.lit("import { R } from '../region/"), slug("r_name"), F.lit("';")).alias("content")),
        t("region").select(F.concat(F.lit("src/region/"), slug("r_name"), F.lit("/index.ts")).alias("path"), F.lit("").alias("content")),
    ]
    out = files[0]
    for f in files[1:]:
        out = out.unionByName(f)
    return out.select("path", F.lit(False).alias("is_dir"), "content")
