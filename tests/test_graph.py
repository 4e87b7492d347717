import itertools
import random

from arcweft.operators import graph


def edges_df(spark, edges):
    seen = {}
    rows = []
    for a, b in edges:
        rows.append((a, b, seen.setdefault(a, 0)))
        seen[a] += 1
    return spark.createDataFrame(rows, "src string, dst string, ord int")


def bfs(edges, start):
    """Shortest chains by breadth first search in import order."""
    out, queue = {start: [start]}, [start]
    for at in queue:
        for a, b in edges:
            if a == at and b not in out:
                out[b] = [*out[at], b]
                queue.append(b)
    return out


def random_edges(seed, n, m):
    r = random.Random(seed)
    return [(f"v{r.randrange(n)}", f"v{r.randrange(n)}") for _ in range(m)]


def test_chains_on_random_multigraphs(spark):
    all_edges, expected = [], {}
    for k in range(25):  # many graphs at once, told apart by a prefix
        edges = [(f"{k}/{a}", f"{k}/{b}") for a, b in random_edges(k, 6, 9)]
        all_edges += edges
        for s in {a for a, _ in edges}:
            for d, chain in bfs(edges, s).items():
                expected[s, d] = chain
    df = edges_df(spark, all_edges)
    got = {(r.src, r.dst): r.chain for r in graph.reachable(df, df.select("src")).collect()}
    assert got == expected
    back = {(r.src, r.dst): r.chain for r in graph.reaching(df, df.select("dst")).collect()}
    assert {k: v for k, v in back.items() if k in expected} == {k: v for k, v in expected.items() if k[1] in {b for _, b in all_edges}}
    assert {(r.src, r.dst): r.hops for r in graph.distances(df, df.select("src")).collect()} == {k: len(v) - 1 for k, v in expected.items()}
    few = df.select("src").distinct().orderBy("src").limit(4)
    for sources, targets in ((few, df.select("dst")), (df.select("src"), few.select(few.src.alias("dst")))):
        s, t = {r.src for r in sources.collect()}, {r.dst for r in targets.collect()}
        assert {(r.src, r.dst): r.chain for r in graph.chains_between(df, sources, targets).collect()} == {k: v for k, v in expected.items() if k[0] in s and k[1] in t}


def test_components_and_loops_on_random_graphs(spark):
    all_edges, comps, loops = [], {}, {}
    for k in range(25):
        edges = [(f"{k}/{a}", f"{k}/{b}") for a, b in random_edges(100 + k, 6, 8)]
        all_edges += edges
        ids = {x for e in edges for x in e}
        reach = {s: set(bfs(edges, s)) for s in ids}
        for s in ids:
            comps[s] = min(x for x in ids if x in reach[s] and s in reach[x])
        for start in {c for c in comps.values() if c.startswith(f"{k}/")}:
            members = sorted(x for x in ids if comps[x] == start)
            walks = [[start, *rest] for n in range(len(members)) for rest in itertools.permutations([m for m in members if m != start], n)]
            closed = [w for w in walks if all(e in edges for e in zip(w, [*w[1:], start], strict=True))]
            if closed:
                loops[start] = min(closed, key=lambda w: (len(w), w))
    df = edges_df(spark, all_edges)
    ids = df.select(df.src.alias("id")).union(df.select(df.dst.alias("id")))
    assert {r.id: r.component for r in graph.strong_components(df, ids).collect()} == comps
    assert {r.start: r.loop for r in graph.loops(df).collect()} == loops


def test_known_graphs(spark):
    df = edges_df(spark, [("a", "b"), ("a", "react"), ("b", "c")])
    assert sorted(r.dst for r in graph.reachable(df, spark.createDataFrame([("a",)], "src string")).collect()) == ["a", "b", "c", "react"]
    loop = edges_df(spark, [("d", "b"), ("d", "c"), ("b", "d"), ("c", "d"), ("c", "e"), ("e", "d")])
    assert [(r.start, r.loop) for r in graph.loops(loop).collect()] == [("b", ["b", "d"])]
    only = edges_df(spark, [("a", "a")])
    assert [r.loop for r in graph.loops(only).collect()] == [["a"]]
    modules = spark.createDataFrame([("b",), ("c",)], "module_id string")
    assert graph.loops(loop, modules).count() == 0


def test_empty_graph(spark):
    df = edges_df(spark, []) if False else spark.createDataFrame([], "src string, dst string, ord int")
    assert graph.reachable(df, df.select("src")).count() == 0
    assert graph.strong_components(df).count() == 0 and graph.loops(df).count() == 0


def test_edges_of_files_that_share_an_id(spark):
    rows = [("@/a", "/p/a.tsx", 0, "y"), ("@/a", "/p/a.ts", 0, "x"), ("@/a", "/p/a.ts", 1, "x")]
    df = spark.createDataFrame(rows, "module_id string, path string, ord int, target string")
    assert [(r.dst, r.ord) for r in graph.edges_of(df).orderBy("ord").collect()] == [("x", 0), ("x", 1), ("y", 2)]


def test_levels_leave_out_what_no_edge_leads_to(spark, monkeypatch):
    edges = [(f"leaf{i}", x) for i in range(60) for x in (f"sink{i}", "a", "b")] + [("a", "c"), ("b", "a"), ("b", "c"), ("c", "d")]
    df = edges_df(spark, edges)
    rows, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda d: (out := cut(d), rows.append(out.count()))[0])
    expected = {(s, d): chain for s in {a for a, _ in edges} for d, chain in bfs(edges, s).items()}
    back = {(r.src, r.dst): r.chain for r in graph.reaching(df, spark.createDataFrame([("d",)], "dst string")).collect()}
    assert back == {k: v for k, v in expected.items() if k[1] == "d"} | {("d", "d"): ["d"]}
    assert {(r.src, r.dst): r.hops for r in graph.distances(df, df.select("src")).collect()} == {k: len(v) - 1 for k, v in expected.items()}
    assert max(rows) < 60
