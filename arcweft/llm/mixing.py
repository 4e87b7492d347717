"""Mixing sources to target weights by systematic sampling. [native]

Every document of a source is expected in the mix `target / source size` times. Its source's documents stand in the order
of their size; the expected copies are summed up along that order from one pseudo-random offset per source, and a
document is taken once for each integer boundary that its share of the sum crosses. As the order is by size, the words
taken differ from the target by less than about the size of the largest document.

Targets: the sources in code-point order (null last) weigh `WEIGHTS` in turn, and share `share` times all words. No
target exceeds `most` times its source's words; the excess is dealt again by weight until no target does.

Null and empty texts have size 0 and come once for each boundary they cross, texts of any length count whole; null sources are one source.
Rows that repeat each count. `mix` keeps all columns whatever their names; only doc_id, source and text are read. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arcweft.llm.common import WORD, cut, ranked

#: Fixed values of the contract.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2


def sizes(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, source and size (words of the text; 0 for null) of every row."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD))
    return docs.select("doc_id", "source", words.cast("long").alias("size"), *keep)


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target: one row per source.

    Dealing the excess again until none is above its bound is the same as filling to one level: with the sources in
    ascending order of bound per weight, the first of them that the level of the rest does not fill sets the level. All
    windows are over one row per source, after a sum with map-side combination.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights)) + 1)
    by_source = by_source.withColumn("weight", weight.cast("double")).withColumn("bound", F.col("source_size").cast("double") * most)
    order = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("bound").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    everyone = Window.partitionBy(F.lit(0))
    level = by_source.withColumn("level", (F.sum("source_size").over(everyone) * share - before) / rest)
    fits = F.col("bound") >= F.col("level") * F.col("weight")
    level = level.withColumn("level", F.max(F.when(fits, F.col("level"))).over(everyone))  # levels only sink from the first that fits on
    target = F.least(F.col("bound"), F.coalesce(F.col("level") * F.col("weight"), F.col("bound")))
    return level.select("source", "source_size", target.alias("target"))


def copies(sized: DataFrame, seed: str = "mix", **options: float) -> DataFrame:
    """`sized` (doc_id, source, size and further columns) with source_size, target and copies.

    Repeated rows each count. Equal rows may swap their numbers, which changes no result as a multiset. A source of
    any share of the rows is spread over all tasks (`ranked`). Empty input gives no rows.
    """
    sized = cut(sized)
    per_source = targets(sized, **options)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("double") / 2.0**32
    per_source = per_source.withColumn("_offset", offset).withColumn("_each", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    row = ranked(sized, ["size", "doc_id", *[c for c in sized.columns if c not in ("doc_id", "source", "size")]], group="source", per_group=per_source)
    upto = lambda r: F.floor(F.col("_each") * r + F.col("_offset"))
    taken = F.least(upto(F.col("rank") + 1) - upto(F.col("rank")), F.lit(options.get("most", MOST)))
    return row.withColumn("copies", taken.cast("long")).drop("rank", "_each", "_offset")


def mix(docs: DataFrame, seed: str = "mix", **options: float) -> DataFrame:
    """The mix itself: every row of `docs`, all columns (whatever their names), as often as it is taken."""
    key = ["_k", "_t"]
    whole = F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in docs.columns])
    keyed = docs.select("doc_id", "source", "text", F.coalesce("doc_id", F.lit(-(2**63)).cast("long")).alias("_k"), whole.alias("_t"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    taken = copies(sizes(keyed, *key), seed, **options)
    taken = taken.groupBy(*key).agg(F.sum("copies").alias("_all"), F.count(F.lit(1)).alias("_rows"))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0)))  # of rows equal in every column
    upto = lambda i: F.floor(F.col("_all") * i / F.col("_rows"))
    rows = keyed.select(*key, "_row").join(taken, key).withColumn("_nth", nth)
    rows = rows.withColumn("_copies", (upto(F.col("_nth")) - upto(F.col("_nth") - 1)).cast("int")).filter("_copies > 0")
    return rows.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).select("_row.*")
