"""Whole runs over a project: check, fix and baseline.

`analyse` is the plan: files to modules to imports to graph to problems, all as DataFrames. `check`, `fix` and `baseline` add what a
command does besides. A project is a folder with tsconfig.json; its rulebooks and baseline lie in a folder of their own in it
(`home`, by default `arcweft`), as `rules/*` and `baseline.yaml`. A folder given by an address (`hdfs://host/project`, `file:///project`)
lies in a store: executors read its sources, the driver only the listing, ignore files, configuration, rulebooks and baseline.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweft.operators import graph, lints, parse, problems, resolve
from arcweft.operators.enforce import enforce
from arcweft.plans.lineage import cut
from arcweft.plans.report import Run, rule_count
from arcweft.plans.rulebooks import Rulebook, load_rulebooks, read_rulebooks
from arcweft.sources.aliases import Config, ConfigError, load_config, parse_config
from arcweft.sources.project import local_files, modules_of, stored_files
from arcweft.sources.store import folder_of, is_address, names_in, read_text, write_text

HOME = "arcweft"


@dataclass
class Analysis:
    """The relations of a run; paths are absolute."""

    modules: DataFrame
    nodes: DataFrame
    imports: DataFrame
    edges: DataFrame
    vertices: DataFrame
    found: DataFrame
    unreadable: DataFrame


def analyse(files: DataFrame, root: str, config: Config, rulebooks: list[Rulebook], baseline: DataFrame | None = None, rules: bool = True) -> Analysis:
    """Everything about a project from its files (path, is_dir, content), paths relative to `root`.

    Imports are rewritten to canonical ids before graph and rules see them, except in files whose relative imports
    the baseline accepts. `rules=False` stops before graph and rules. Problems are neither suppressed nor compacted.
    """
    absolute = F.concat(F.lit(root.rstrip("/") + "/"), "path")
    to_parse = modules_of(files, os.path.basename(root.rstrip("/"))).withColumn("path", absolute)
    unreadable = to_parse.filter("content is null").select("path")  # no modules
    nodes = cut(parse.nodes(to_parse))
    modules = cut(resolve.module_ids(nodes.select("path").distinct(), config))
    everywhere = files.filter(~F.col("is_dir")).select(absolute.alias("path"))
    named = resolve.canonical(nodes.filter("target is not null"), everywhere, config).unionByName(nodes.filter("target is null").withColumn("canonical", F.lit(None).cast("string")))
    named = cut(named)
    relative, nodes = lints.relative_imports(named, config.base_url, baseline)
    nodes = cut(nodes)
    imports = parse.imports(nodes).join(modules, "path")
    edges = graph.edges_of(imports)
    vertices = graph.vertices_of(edges, modules)
    found = relative
    if rules:
        imports, edges = cut(imports), cut(edges)
        vertices = cut(graph.vertices_of(edges, modules))
        found = found.unionByName(enforce(modules, imports, edges, vertices, rulebooks)).unionByName(lints.import_cycles(edges, imports, modules, config.base_url))
    return Analysis(modules, nodes, imports, edges, vertices, cut(found), unreadable)


def baseline_path(project: str, home: str = HOME) -> str:
    return os.path.join(project, home, "baseline.yaml")


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(problem_id) from a YAML list; none if the file is missing or no such list."""
    ids: list[str] = []
    try:
        import yaml

        raw = yaml.load(read_text(spark, path), Loader=yaml.BaseLoader)
        if isinstance(raw, list) and all(isinstance(x, str) for x in raw):
            ids = [x.strip() for x in raw]
    except (OSError, UnicodeDecodeError):
        pass
    except Exception as e:  # noqa: BLE001  a malformed file counts as empty
        if type(e).__module__.partition(".")[0] != "yaml":
            raise
    return spark.createDataFrame([(x,) for x in ids], "problem_id string")


def save_baseline(found: DataFrame, path: str) -> int:
    """Writes the ids of the problems, sorted, each once; returns how many."""
    ids = [r.problem_id for r in problems.baseline_ids(found).collect()]
    write_text(found.sparkSession, path, "".join(f"- {_scalar(i)}\n" for i in ids) if ids else "[]\n")
    return len(ids)


def _scalar(text: str) -> str:
    """A YAML scalar: plain where that is safe, else in single quotes."""
    plain = text and not set(text) & set(":{}[],&*!|>'\"%`\n\t") and text[0] not in "#-?@ " and not text.endswith(" ") and " #" not in text
    return text if plain else "'" + text.replace("'", "''") + "'"


def _project(spark: SparkSession, project: str, home: str) -> tuple[str, Config, list[Rulebook], DataFrame]:
    root = folder_of(spark, project)
    if not is_address(project):
        return root, load_config(os.path.join(root, "tsconfig.json")), load_rulebooks(os.path.join(root, home, "rules")), local_files(spark, root)
    rulebooks = rulebooks_at(spark, f"{project.rstrip('/')}/{home}/rules")
    try:
        config = parse_config(read_text(spark, f"{project.rstrip('/')}/tsconfig.json"), root)
    except FileNotFoundError as e:
        raise ConfigError(f"tsconfig.json not found in '{project}'") from e
    return root, config, rulebooks, stored_files(spark, project)


def rulebooks_at(spark: SparkSession, folder: str) -> list[Rulebook]:
    """The rulebooks in a folder, local or in a store."""
    if not is_address(folder):
        return load_rulebooks(folder)
    return read_rulebooks([(name, read_text(spark, f"{folder}/{name}")) for name in names_in(spark, folder)])


def _kept_in(project: str, root: str) -> str:
    return project.rstrip("/") if is_address(project) else root


def _unread(done: Analysis) -> tuple[str, ...]:
    return tuple(r.path for r in done.unreadable.orderBy(F.split("path", "/")).collect())


def check(spark: SparkSession, project: str = ".", home: str = HOME) -> tuple[DataFrame, Run]:
    """Problems that the baseline does not accept, compacted and in order, with their text; and the run."""
    root, config, rulebooks, files = _project(spark, project, home)
    accepted = load_baseline(spark, baseline_path(_kept_in(project, root), home))
    done = analyse(files, root, config, rulebooks, accepted)
    found = cut(problems.formatted(problems.compacted(problems.suppressed(done.found, accepted))))
    n = problems.counts(found).first()
    return problems.ordered(found), Run("check", done.modules.count(), rule_count(rulebooks), n.total, n.auto_fixable, _unread(done))


def baseline(spark: SparkSession, project: str = ".", home: str = HOME) -> tuple[DataFrame, Run]:
    """All problems, compacted, with no regard to an old baseline; their ids are written as the new one."""
    root, config, rulebooks, files = _project(spark, project, home)
    done = analyse(files, root, config, rulebooks)
    found = cut(problems.compacted(done.found))
    save_baseline(found, baseline_path(_kept_in(project, root), home))
    return problems.ordered(found), Run("baseline", done.modules.count(), rule_count(rulebooks), found.count(), unreadable=_unread(done))


def rewrites(done: Analysis, files: DataFrame, root: str) -> DataFrame:
    """(path, content) of files whose imports were rewritten to another text."""
    old = files.select(F.concat(F.lit(root.rstrip("/") + "/"), "path").alias("path"), F.col("content").alias("_old"))
    return parse.rendered(done.nodes).join(old, "path").filter(F.col("content") != F.col("_old")).select("path", "content")


def fix(spark: SparkSession, project: str = ".", home: str = HOME) -> tuple[list[str], Run]:
    """Rewrites imports in place, except in files that the baseline accepts; returns the changed paths in order.

    Each changed file is written by the driver, one at a time as rows come in. Rules are loaded, so that they can
    fail, but not enforced.
    """
    root, config, rulebooks, files = _project(spark, project, home)
    accepted = load_baseline(spark, baseline_path(_kept_in(project, root), home))
    done = analyse(files, root, config, rulebooks, accepted, rules=False)
    changed = []
    for row in rewrites(done, files, root).orderBy(F.split("path", "/")).toLocalIterator():
        write_text(spark, _kept_in(project, root) + row.path[len(root) :], row.content)
        changed.append(row.path)
    n = problems.counts(problems.compacted(problems.suppressed(done.found, accepted))).first()
    return changed, Run("fix", done.modules.count(), rule_count(rulebooks), n.total, n.auto_fixable, _unread(done))
