"""Name resolution: from import specifiers to files, and from files to the ids of modules.

The configuration's aliases are a small relation in order of precedence. Paths become ids by its values (`module_ids`),
specifiers become paths by its keys and by probing for files (`canonical`); both are joins that keep the first match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweft.sources.aliases import AliasPattern, Config

#: Endings that a specifier may leave out, in the order they are tried; extensions that ids do without.
PROBES = (".ts", ".tsx", "/index.ts", "/index.tsx")
SCRIPT, DECLARATION = r"\.(?:ts|tsx|mts|cts|js|jsx|mjs|cjs)$", r"\.d\.(?:ts|mts|cts)$"


def is_relative(target: Column) -> Column:
    return target.isin(".", "..") | target.startswith("./") | target.startswith("../") | target.startswith("/")


def without_extension(path: Column) -> Column:
    """The path without script extension; declarations lose both parts of theirs. Names that are nothing else keep it."""
    bare = F.when(path.rlike(DECLARATION), F.regexp_replace(path, DECLARATION, "")).otherwise(F.regexp_replace(path, SCRIPT, ""))
    return F.when((F.length(bare) > 0) & ~bare.endswith("/"), bare).otherwise(path)


def normal(path: Column) -> Column:
    """A path without `.` and `..`; `..` at the top does nothing."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    done = F.aggregate(parts, F.array().cast("array<string>"), lambda d, p: F.when(p == "..", F.slice(d, F.lit(1), F.greatest(F.size(d) - 1, F.lit(0)))).otherwise(F.array_append(d, p)))
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(done, "/"))


def _capture(pattern: AliasPattern, text: Column) -> Column:
    """What the `*` stands for (empty for an equal exact pattern), null without a match."""
    if pattern.exact:
        return F.when(text == pattern.before, F.lit(""))
    before, after = pattern.before, pattern.after
    fits = text.startswith(before) & text.endswith(after) & (F.length(text) >= len(before) + len(after))
    return F.when(fits, F.substring(text, F.lit(len(before) + 1), F.length(text) - (len(before) + len(after))))


def _put(pattern: AliasPattern, capture: Column) -> Column:
    return F.lit(pattern.before) if pattern.exact else F.concat(F.lit(pattern.before), capture, F.lit(pattern.after))


def with_alias(rows: DataFrame, config: Config, path: str, name: str) -> DataFrame:
    """`rows` with `name`: the id that aliases give to the absolute path, null if none does.

    The path is taken relative to the base folder (`..` in its own text plays no part there). The first mapping with a
    value that matches decides; one with a `*` value under an exact key passes on; an id that would be relative is none.
    Steps are columns of their own, so that none is written out more than once.
    """
    base = [p for p in config.base_url.split("/") if p not in ("", ".", "..")]
    parts = F.filter(F.split(without_extension(F.col(path)), "/"), lambda p: ~p.isin("", ".", ".."))
    own = F.array(*map(F.lit, base)) if base else F.array().cast("array<string>")
    same = F.size(F.filter(F.sequence(F.lit(1), F.lit(len(base))), lambda k: F.slice("_parts", F.lit(1), k) == F.slice(own, F.lit(1), k))) if base else F.lit(0)
    up = F.array_repeat(F.lit(".."), F.lit(len(base)) - F.col("_same"))
    rows = rows.withColumn("_parts", parts).withColumn("_same", same)
    rows = rows.withColumn("_below", F.array_join(F.concat(up, F.slice("_parts", F.col("_same") + 1, F.greatest(F.size("_parts"), F.lit(1)))), "/"))
    choices = []
    for alias in config.aliases:
        found = [F.when(_matches(v, F.col("_below")), _alias(alias.key, v)) for v in alias.values]
        choices.append(F.coalesce(*found))
    chosen = F.coalesce(*choices) if choices else F.lit(None).cast("string")
    # an exact key under a `*` value passes on to the next mapping, so it is null above
    return rows.withColumn("_chosen", chosen).withColumn(name, F.when(~is_relative(F.col("_chosen")), F.col("_chosen"))).drop("_parts", "_same", "_below", "_chosen")


def _matches(pattern: AliasPattern, text: Column) -> Column:
    if pattern.exact:
        return text == pattern.before
    return text.startswith(pattern.before) & text.endswith(pattern.after) & (F.length(text) >= len(pattern.before) + len(pattern.after))


def _alias(key: AliasPattern, value: AliasPattern) -> Column:
    """The id under a key for a path that the value matches."""
    if value.exact or key.exact:
        return F.lit(key.before + (key.after or "")) if value.exact else F.lit(None).cast("string")
    length = F.length("_below") - (len(value.before) + len(value.after))
    return F.concat(F.lit(key.before), F.substring("_below", F.lit(len(value.before) + 1), length), F.lit(key.after))


def module_ids(paths: DataFrame, config: Config) -> DataFrame:
    """`paths` (path, absolute) with module_id: the alias, or else the path without extension."""
    return with_alias(paths, config, "path", "_alias").withColumn("module_id", F.coalesce("_alias", without_extension(F.col("path")))).drop("_alias")


def canonical(imports: DataFrame, files: DataFrame, config: Config) -> DataFrame:
    """`imports` (path, target and more) with canonical: the id of what the target names, or the target itself.

    `files` (path, absolute) are all files there are, also ignored ones. Relative targets go by the importing file's
    folder, and stand for their own path where no file is found; others go by the aliases' keys, to the first mapping and
    value under which a file is found. Targets that end up as their own `/index` keep their text, as do those
    that resolve to nothing or to a path without id. Each distinct (folder, target) is looked up once.
    """
    folder = F.regexp_replace("path", r"/[^/]*$", "")
    imports = imports.withColumn("_folder", F.when(is_relative(F.col("target")), folder).otherwise(F.lit("")))
    asked = imports.select("_folder", "target").distinct()
    own = F.when(F.col("target").startswith("/"), F.col("target")).otherwise(F.concat_ws("/", "_folder", "target"))
    tries = [F.when(is_relative(F.col("target")), F.array(F.struct(F.lit(0).alias("rank"), normal(own).alias("at"))))]
    rank, options = 0, []
    base = config.base_url.rstrip("/")
    for alias in config.aliases:
        capture = _capture(alias.key, F.col("target"))
        for value in alias.values:
            rank += 1
            rel = F.regexp_replace(_put(value, capture), "/+$", "")
            at = F.when(rel.startswith("/"), rel).otherwise(F.concat(F.lit(base + "/"), rel))
            options.append(F.when(capture.isNotNull(), F.struct(F.lit(rank).alias("rank"), at.alias("at"))))
    tries.append(F.filter(F.array(*options), lambda x: x.isNotNull()) if options else F.array().cast("array<struct<rank:int,at:string>>"))
    probes = F.array(*[F.struct(F.lit(i).alias("probe"), F.lit(p).alias("ending")) for i, p in enumerate(PROBES)])
    each = asked.select("_folder", "target", F.explode(F.coalesce(*tries)).alias("_try")).select("_folder", "target", "_try.*").withColumn("_p", F.explode(probes))
    each = each.withColumn("path", _folded(F.concat("at", F.col("_p.ending"))))
    found = each.join(files.select("path").distinct(), "path", "left_semi")
    first = found.groupBy("_folder", "target").agg(F.min_by("path", F.struct("rank", "_p.probe")).alias("_found"))
    resolved = asked.join(first, ["_folder", "target"], "left").withColumn("_at", F.coalesce("_found", F.when(is_relative(F.col("target")), normal(own))))
    resolved = with_alias(resolved, config, "_at", "_alias")
    keeps = F.col("_alias").isNull() | (F.col("_alias") == F.concat("target", F.lit("/index")))
    resolved = resolved.select("_folder", "target", F.when(keeps, F.col("target")).otherwise(F.col("_alias")).alias("canonical"))
    return imports.join(resolved, ["_folder", "target"]).drop("_folder")


def _folded(path: Column) -> Column:
    """A probe's path as files are listed: `.` and `..` resolved, as a file system does it."""
    return F.when(path.contains("/./") | path.contains("/../") | path.contains("//"), normal(path)).otherwise(path)
