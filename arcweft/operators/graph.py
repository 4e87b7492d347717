"""The import graph: edges and vertices, reachability with shortest chains, strong components, shortest loops.

Edges are (src, dst, ord): ord tells parallel edges and neighbours of a source in the order of its imports. Loops over
levels join a frontier with the edges and keep one row per pair or vertex by a minimum; each level is checkpointed.
Chains between given sources and targets are searched from the side that has fewer: what lies between many sources and few
targets is then gone through once a target and not once a source. What no edge leads to (most vertices, where many files import
few) takes part in no level: levels go through the inner part, and such vertices meet it in one pass. A vertex that a large share of all edges share is a skewed
key of a plain join of two exchanges, which adaptive execution splits.
Between equally short chains the one whose edges come first in import order wins; between equally short loops the one
whose ids come first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arcweft.plans.lineage import cut


#: Fixed value: bits of a sieve, 8 MB in rows of 64.
SIEVE = 1 << 26


def edges_of(imports: DataFrame) -> DataFrame:
    """(src, dst, ord) from imports (module_id, path, ord, target): files that share an id are read in walk order."""
    order = F.row_number().over(Window.partitionBy("module_id").orderBy(F.split("path", "/"), "ord")) - 1
    return imports.select(F.col("module_id").alias("src"), F.col("target").alias("dst"), order.alias("ord"))


def vertices_of(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """(id, is_external): all modules (module_id) and all targets; external is what no module provides."""
    known = modules.select(F.col("module_id").alias("id")).distinct().withColumn("is_external", F.lit(False))
    return known.unionByName(edges.select(F.col("dst").alias("id")).distinct().join(known, "id", "left_anti").withColumn("is_external", F.lit(True)))


def reachable(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(src, dst, chain): everything that each of `sources` (src) reaches, itself included, by a shortest chain.

    Semi-naive: a level joins only what the level before found, and drops what is known. Only the given sources are
    followed, never all pairs of the graph.
    """
    steps = cut(edges.groupBy("src", "dst").agg(F.min("ord").alias("ord")))
    start = sources.select("src").distinct().select("src", F.col("src").alias("dst"), F.array().cast("array<int>").alias("ords"), F.array("src").alias("chain"))
    known = frontier = cut(start)
    while not frontier.isEmpty():
        hop = frontier.join(steps.select(F.col("src").alias("dst"), F.col("dst").alias("to"), "ord"), "dst")
        hop = hop.select("src", F.col("to").alias("dst"), F.array_append("ords", F.col("ord")).alias("ords"), F.array_append("chain", F.col("to")).alias("chain"))
        new = hop.join(known.select("src", "dst"), ["src", "dst"], "left_anti").groupBy("src", "dst").agg(F.min(F.struct("ords", "chain")).alias("best"))
        frontier = cut(new.select("src", "dst", "best.ords", "best.chain"))
        known = known.unionByName(frontier)
    return known.select("src", "dst", "chain")


def sieve_of(ids: DataFrame) -> DataFrame:
    """(_word, _bits): a bitmap of fixed size of hashes of ids (one column), as rows; see `sifted`."""
    h = F.col("_hash")
    bits = F.bit_or(F.expr("shiftleft(1L, cast(_hash & 63 as int))")).alias("_bits")
    return cut(ids.select(F.xxhash64(ids.columns[0]).bitwiseAND(F.lit(SIEVE - 1)).alias("_hash")).groupBy(F.shiftright(h, 6).alias("_word")).agg(bits))


def sifted(rows: DataFrame, column: str, sieve: DataFrame) -> DataFrame:
    """`rows` whose column may be among a sieve's ids: all that are and some more, so that an exact join goes after it."""
    hashed = rows.withColumn("_hash", F.xxhash64(column).bitwiseAND(F.lit(SIEVE - 1)))
    met = hashed.join(F.broadcast(sieve), F.shiftright("_hash", 6) == F.col("_word"))
    return met.filter("shiftright(_bits, cast(_hash & 63 as int)) & 1L = 1L").select(rows.columns)


def inner_part(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (id) that edges lead to and from, and the edges that begin at one.

    Whatever else a search of the graph finds is one edge away from what it finds on the inner part.
    """
    middle = cut(edges.select(F.col("src").alias("id")).distinct().join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_semi"))
    inner = sifted(edges, "src", sieve_of(middle)).join(middle.withColumnRenamed("id", "src"), "src", "left_semi")
    return middle, cut(inner.groupBy("src", "dst").agg(F.min("ord").alias("ord")) if "ord" in edges.columns else inner.select("src", "dst").distinct())


def _distances(steps: DataFrame, sources: DataFrame) -> DataFrame:
    """(src, dst, hops) over steps (src, dst), each once."""
    known = frontier = cut(sources.select("src").distinct().select("src", F.col("src").alias("dst"), F.lit(0).alias("hops")))
    while not frontier.isEmpty():
        hop = frontier.join(steps.select(F.col("src").alias("dst"), F.col("dst").alias("to")), "dst").select("src", F.col("to").alias("dst"), (F.col("hops") + 1).alias("hops"))
        frontier = cut(hop.distinct().join(known.select("src", "dst"), ["src", "dst"], "left_anti"))
        known = known.unionByName(frontier)
    return known


def distances(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(src, dst, hops) of what `reachable` finds, without the chains: rows of fixed size.

    Where more sources than inner vertices are asked for, hops within the inner part are found first, and the first hop of all
    sources is put before them in one pass; else levels start from the sources.
    """
    edges, sources = edges.select("src", "dst"), sources.select("src").distinct()
    middle, inner = inner_part(edges)
    if middle.count() >= sources.count():
        return _distances(cut(edges.distinct()), sources)
    deep = cut(_distances(inner, middle.withColumnRenamed("id", "src")).filter("hops > 0"))
    later = sifted(edges, "dst", sieve_of(deep.select("src"))).select("src", F.col("dst").alias("via")).join(deep.withColumnRenamed("src", "via"), "via")
    found = edges.select("src", "dst", F.lit(1).alias("hops")).unionByName(later.select("src", "dst", (F.col("hops") + 1).alias("hops")))
    found = found.unionByName(sources.select("src", F.col("src").alias("dst"), F.lit(0).alias("hops"))).repartition("src")
    return found.join(sources.hint("shuffle_hash"), "src", "left_semi").groupBy("src", "dst").agg(F.min("hops").alias("hops"))


def reaching(edges: DataFrame, targets: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(src, dst, chain): everything (of `sources`, if given) that reaches each of `targets` (dst), itself included, by a shortest chain.

    The counterpart of `reachable`, from the end: of equally short chains from a vertex, those of its neighbours are known and the
    best one begins with an edge and goes on with the best one from there, so that both choose the same chain. Levels go
    through the inner part only; what no edge leads to has its one edge put before them at last. Rows come partitioned by src.
    """
    return _reaching(edges.select("src", "dst", "ord"), targets, sources)[0]


def _reaching(edges: DataFrame, targets: DataFrame, sources: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """`reaching`, and a sieve of all vertices that its chains go through behind their first."""
    _, inner = inner_part(edges)
    start = targets.select("dst").distinct().select(F.col("dst").alias("src"), "dst", F.array().cast("array<int>").alias("ords"), F.array("dst").alias("chain"))
    known = frontier = cut(start)
    while not frontier.isEmpty():
        hop = _put_before(inner, frontier)
        new = hop.join(known.select("src", "dst"), ["src", "dst"], "left_anti").groupBy("src", "dst").agg(F.min(F.struct("ords", "chain")).alias("best"))
        frontier = cut(new.select("src", "dst", "best.ords", "best.chain"))
        known = known.unionByName(frontier)
    through = sieve_of(known.select("src"))
    first = sifted(edges, "dst", through)
    if sources is not None and sources.count() * 4 <= SIEVE:
        first = sifted(first, "src", sieve_of(sources.select("src")))
    found = _put_before(first, known).unionByName(known).repartition("src")
    if sources is not None:
        found = found.join(sources.select("src").distinct().hint("shuffle_hash"), "src", "left_semi")
    found = found.groupBy("src", "dst").agg(F.min(F.struct(F.size("ords").alias("_n"), "ords", "chain")).alias("best"))
    return found.select("src", "dst", "best.chain"), through


def _put_before(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Chains (src, dst, ords, chain) with one of the edges put before them."""
    hop = edges.select(F.col("src").alias("from"), F.col("dst").alias("via"), "ord").join(known.withColumnRenamed("src", "via"), "via")
    return hop.select(F.col("from").alias("src"), "dst", F.array_prepend("ords", F.col("ord")).alias("ords"), F.array_prepend("chain", F.col("from")).alias("chain"))


def chains_between(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(src, dst, chain) for those of `sources` (src) and `targets` (dst) that are connected."""
    return chains_through(edges, sources, targets)[0]


def chains_through(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """`chains_between`, and, where it is at hand, a sieve that lets through all that the chains import first."""
    sources, targets = cut(sources.select("src").distinct()), cut(targets.select("dst").distinct())
    if targets.count() <= sources.count():
        return _reaching(edges.select("src", "dst", "ord"), targets, sources)
    return reachable(edges, sources).join(targets, "dst", "left_semi").select("src", "dst", "chain"), None


def shortest_chain(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, dst, chain) of those `pairs` (src, dst) that are connected."""
    return chains_between(edges, pairs.select("src"), pairs.select("dst")).join(pairs.select("src", "dst").distinct(), ["src", "dst"], "left_semi")


def trimmed(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) that may lie on a cycle: ends without way in or out are taken off until none is left."""
    e = cut(edges.select("src", "dst").distinct())
    before = -1
    while (n := e.count()) != before and n:
        before = n
        ends = e.select("src").distinct().join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        e = cut(e.join(ends, "src", "left_semi").join(ends.withColumnRenamed("src", "dst"), "dst", "left_semi"))
    return e


def strong_components(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(id, component): component is the smallest id that a vertex reaches and is reached by.

    By colours: each vertex takes the smallest id that reaches it; the root of a colour and what reaches the root within
    the colour are a component; the rest goes on. Space is linear in the graph, unlike mutual reachability. With
    `vertices` (id), those on no cycle are components of their own.
    """
    e = trimmed(edges)
    done: DataFrame | None = None
    while not e.isEmpty():
        colour = cut(e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct().withColumn("colour", F.col("id")))
        while True:
            to = e.join(colour.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("_other"))
            moved = cut(colour.join(to, "id", "left").select("id", F.least("colour", "_other").alias("new"), "colour"))
            stable = moved.filter("new <> colour").isEmpty()
            colour = moved.select("id", F.col("new").alias("colour"))
            if stable:
                break
        inner = e.join(colour.select(F.col("id").alias("src"), F.col("colour").alias("_c")), "src").join(colour.select(F.col("id").alias("dst"), "colour"), "dst").filter("_c = colour").select("src", "dst", "colour")
        inner = cut(inner)
        found = frontier = cut(colour.filter("id = colour").select("id", F.col("colour").alias("component")))
        while not frontier.isEmpty():
            back = inner.join(frontier.select(F.col("id").alias("dst"), "component"), "dst").filter("component = colour").select(F.col("src").alias("id"), "component").distinct()
            frontier = cut(back.join(found, "id", "left_anti"))
            found = cut(found.unionByName(frontier))
        done = found if done is None else done.unionByName(found)
        rest = e.join(found.select(F.col("id").alias("src")), "src", "left_anti").join(found.select(F.col("id").alias("dst")), "dst", "left_anti")
        e = trimmed(rest)
    if done is None:
        done = edges.filter(F.lit(False)).select(F.col("src").alias("id"), F.col("src").alias("component"))
    if vertices is not None:
        alone = vertices.select("id").distinct().join(done, "id", "left_anti").select("id", F.col("id").alias("component"))
        done = done.unionByName(alone)
    return done


def loops(edges: DataFrame, modules: DataFrame | None = None) -> DataFrame:
    """(start, loop): one shortest loop for each component with a cycle, from its smallest id, without the repeated start.

    With `modules` (module_id), components with a vertex that no module provides are left out.
    """
    on_cycle = strong_components(edges)
    inner = edges.select("src", "dst").distinct().join(on_cycle.select(F.col("id").alias("src"), "component"), "src").join(on_cycle.select(F.col("id").alias("dst"), F.col("component").alias("_to")), "dst").filter("component = _to").select("src", "dst", "component")
    if modules is not None:
        foreign = on_cycle.join(modules.select(F.col("module_id").alias("id")).distinct(), "id", "left_anti").select("component").distinct()
        inner = inner.join(foreign, "component", "left_anti")
    inner = cut(inner)
    closing = inner.filter("dst = component").select("component", F.col("src").alias("at"))
    frontier = cut(inner.select("component").distinct().select("component", F.col("component").alias("at"), F.array("component").alias("walk")))
    seen, out = frontier.select("component", "at"), None
    while not frontier.isEmpty():
        closed = cut(frontier.join(closing, ["component", "at"], "left_semi").groupBy("component").agg(F.min("walk").alias("loop")))
        out = closed if out is None else out.unionByName(closed)
        hop = frontier.join(closed, "component", "left_anti").join(inner.select("component", F.col("src").alias("at"), "dst"), ["component", "at"])
        new = hop.select("component", F.col("dst").alias("at"), F.array_append("walk", F.col("dst")).alias("walk")).join(seen, ["component", "at"], "left_anti")
        frontier = cut(new.groupBy("component", "at").agg(F.min("walk").alias("walk")))
        seen = seen.unionByName(frontier.select("component", "at"))
    if out is None:
        return frontier.select(F.col("component").alias("start"), F.col("walk").alias("loop"))
    return out.select(F.col("component").alias("start"), "loop")
