"""Exact top-k search by inner product: a Voronoi kNN join over integer vectors.

Queries and data are grouped by their nearest pivots. Of each data cell only a summary is known everywhere: its pivot c, how
many vectors it has and the 2 k smallest distances d of its vectors to c, of no id more than k. For a group of queries with pivot p and
radius u (no query is further from p), every product with a vector of that cell at distance d lies within

    p.c -/+ (u |c| + (|p| + u) d).

The best lower bounds over all summaries, as many as it takes to have k of them beside those of any one id, end with a
score that each query of the group is sure to reach k times (all vectors of one id may be the query's own), so a vector
goes to a group only if its upper bound is no less. Groups are solved
locally, in blocks of bounded size on both sides; the k best of each block are merged by query. The result is exact.

Scores are integers: products are summed in float64 where that is exact and in int64 otherwise. Vectors shorter than the
longest count as padded with zeros. Rows without id or vector play no part, nor do vectors with null components. Ties go to
the smaller id; rows with a query's id are its own and no candidates of it; data rows that repeat each count, queries that
repeat id and vector count once. Fewer than k candidates give fewer rows, empty tables none; other columns are not
read. Products beyond 64 bits are ranked exactly (up to 125 bits) and shown cut to the range of 64.

How much a bound can save is up to the data: where vectors lie far from every pivot compared with how far scores are apart, as random
directions in many dimensions do, every upper bound reaches every query's k-th score, and all blocks of queries meet all blocks of data.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arcweft.llm.common import cut

#: Pivots of data, at least and at most (in between half the root of the number of vectors); queries of a group on average, up to as
#: many groups as pivots; most queries and vectors of a local problem.
PIVOTS, PER_GROUP, QUERIES, VECTORS = (48, 512), 2048, 4096, 16384


@dataclass
class Plan:
    """What every task knows: pivots, and from which distance on a cell's vectors go to a group."""

    pivots: np.ndarray
    groups: np.ndarray
    least: np.ndarray  # [group][cell], inf where nothing is needed
    query_blocks: np.ndarray
    data_blocks: np.ndarray


def _matrix(vectors: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    near, best = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
    for k, p in enumerate(pivots):
        d = np.sqrt(((x - p) ** 2).sum(1))
        closer = d < best
        near[closer], best[closer] = k, d[closer]
    return near, best


def _assigned(rows: DataFrame, pivots: np.ndarray, dims: int) -> DataFrame:
    """(id, v binary of int64, near, d) from (id, v array<long>)."""

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = _matrix(batch["v"], dims)
            near, d = _nearest(x.astype(np.float64), pivots)
            yield pd.DataFrame({"id": batch["id"].to_numpy(), "v": [r.tobytes() for r in x], "near": near, "d": d})

    return rows.mapInPandas(assign, "id long, v binary, near long, d double")


def _pivots(rows: DataFrame, count: int, dims: int) -> np.ndarray:
    """Up to `count` different vectors, those whose hash comes first."""
    drawn = rows.orderBy(F.xxhash64("v"), F.xxhash64("id")).limit(2 * count).select("v").collect()
    return np.unique(_matrix(pd.Series([r.v for r in drawn]), dims), axis=0)[:count].astype(np.float64)


def _sure(lower: list[tuple[float, int]], k: int) -> float:
    """The highest of the falling (bound, id) that at least k vectors of other ids reach, whichever id is left out."""
    of_id: Counter[int] = Counter()
    most = 0
    for n, (bound, i) in enumerate(lower, 1):
        of_id[i] += 1
        most = max(most, of_id[i])
        if n - most >= k:
            return bound
    return -math.inf


def _plan(data: DataFrame, queries: DataFrame, pivots: np.ndarray, groups: np.ndarray, k: int) -> Plan:
    """Bounds from the summaries; what is collected are 2 k numbers and ids a cell and a row a group."""

    def smallest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = pd.DataFrame({"near": [], "id": [], "d": []})
        for batch in batches:
            kept = pd.concat([kept, batch]).astype({"near": "int64", "id": "int64", "d": "float64"}).sort_values(["d", "id"])
            kept = kept.groupby(["near", "id"]).head(k).groupby("near").head(2 * k)
        yield kept.astype({"near": "int64", "id": "int64", "d": "float64"})

    few = data.select("near", "id", "d").mapInPandas(smallest, "near long, id long, d double")
    few = few.withColumn("_own", F.row_number().over(Window.partitionBy("near", "id").orderBy("d"))).filter(F.col("_own") <= k)
    few = few.withColumn("_nth", F.row_number().over(Window.partitionBy("near").orderBy("d", "id"))).filter(F.col("_nth") <= 2 * k)
    nearest = [(r.near, r.id, r.d) for r in few.collect()]
    cells = {r.near: (r.n, r.far) for r in data.groupBy("near").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("far")).collect()}
    asked = {r.near: (r.n, r.far) for r in queries.groupBy("near").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("far")).collect()}
    least = np.full((len(groups), len(pivots)), np.inf)
    query_blocks, data_blocks = np.ones(len(groups), np.int64), np.ones(len(groups), np.int64)
    length = np.sqrt((pivots**2).sum(1))
    for g, (n, u) in asked.items():
        p = groups[g]
        p_length = math.sqrt((p**2).sum())
        products = pivots @ p
        slack = 1e-9 * (p_length + u + 1) * (length + max(far for _, far in cells.values()) + 1) + 1e-6
        lower = sorted(((products[c] - u * length[c] - (p_length + u) * d - slack[c], i) for c, i, d in nearest), reverse=True)
        surely = _sure(lower, k)
        reach = p_length + u
        total = 0
        for c, (count, far) in cells.items():
            gap = surely - slack[c] - products[c] - u * length[c]  # what the distance has to make up for
            if gap <= 0:
                least[g, c] = 0.0
            elif reach > 0:
                least[g, c] = gap / reach * (1 - 1e-9)
            total += count * (least[g, c] <= far)
        query_blocks[g], data_blocks[g] = -(-n // QUERIES), max(1, -(-total // VECTORS))
    return Plan(pivots, groups, least, query_blocks, data_blocks)


def _hash(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(8)


def _sent(rows: DataFrame, plan: Plan, queries: bool) -> DataFrame:
    """(group, query_block, data_block, id, v): each row for every local problem that needs it."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.iloc[at : at + 2000]
                ids, v, near, d = (part[c].to_numpy() for c in ("id", "v", "near", "d"))
                for g in range(len(plan.groups)):
                    i = np.flatnonzero(near == g if queries else d >= plan.least[g, near])
                    if not len(i):
                        continue
                    own, other = (plan.query_blocks[g], plan.data_blocks[g]) if queries else (plan.data_blocks[g], plan.query_blocks[g])
                    mine = (_hash(ids[i]) % np.uint64(own)).astype(np.int64)
                    for b in range(other):
                        block = np.full(len(i), b)
                        yield pd.DataFrame({"g": g, "qb": mine if queries else block, "db": block if queries else mine, "id": ids[i], "v": v[i]})

    return rows.select("id", "v", "near", "d").mapInPandas(send, "g long, qb long, db long, id long, v binary")


def _solve(k: int):  # noqa: ANN202
    def solve(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        nothing = pd.DataFrame({"query_id": [], "query": [], "vec_id": [], "high": [], "low": [], "score": []}).astype("int64")
        if not len(queries) or not len(data):
            return nothing
        q, x = (np.frombuffer(b"".join(t["v"]), np.int64).reshape(len(t), -1) for t in (queries, data))
        ids = data["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        x, ids = x[order], ids[order]
        most = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(x.astype(np.float64)).max(initial=0)) * max(q.shape[1], 1)
        exact, beyond = most < 2**53, most >= 2**62
        xs = x.astype(np.float64) if exact else x.astype(object) if beyond else x
        found = []
        for at in range(0, len(q), 64):
            block = q[at : at + 64]
            scores = (block.astype(np.float64) @ xs.T).astype(np.int64) if exact else (block.astype(object) if beyond else block) @ xs.T
            for row, (own, mark, s) in enumerate(zip(queries["id"].to_numpy()[at : at + 64], queries["mark"].to_numpy()[at : at + 64], scores, strict=True)):
                others = ids != own
                c = s[others]
                if not len(c):
                    continue
                ci = ids[others]
                if beyond:
                    i = np.array(sorted(range(len(c)), key=lambda j: -c[j])[:k])  # noqa: B023
                else:
                    i = np.flatnonzero(c >= np.partition(c, len(c) - k)[len(c) - k]) if len(c) > k else np.arange(len(c))
                    i = i[np.argsort(-c[i], kind="stable")[:k]]  # ids ascend, so ties keep the smaller
                cut_to = lambda x: np.clip(x, -(2**63), 2**63 - 1).astype(np.int64)
                found.append(pd.DataFrame({"query_id": own, "query": mark, "vec_id": ci[i], "high": cut_to(c[i] >> 62), "low": (c[i] & (2**62 - 1)).astype(np.int64), "score": cut_to(c[i])}))
        return pd.concat(found) if found else nothing

    return solve


def top_k(data: DataFrame, queries: DataFrame, k: int = 20, pivots: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of `queries` its k best of `data`; both (vec_id, v array<long>)."""
    usable = lambda t: t.select(F.col("vec_id").alias("id"), "v").filter("vec_id is not null and v is not null and not exists(v, x -> x is null)")
    data, queries = usable(data), usable(queries).distinct()
    shape = data.select(F.size("v").alias("n")).unionByName(queries.select(F.size("v").alias("n"))).agg(F.max("n").alias("dims"), F.count(F.lit(1)).alias("rows")).first()
    pivots = pivots or min(max(math.isqrt(shape.rows) // 2, PIVOTS[0]), PIVOTS[1])
    asked = queries.count()
    schema = "query_id long, rank int, vec_id long, score long"
    centres = _pivots(data, pivots, shape.dims or 0) if asked else np.empty((0, 0))
    if not asked or not len(centres):
        return data.sparkSession.createDataFrame([], schema)
    dims = shape.dims
    groups = _pivots(queries, min(pivots, max(1, asked // PER_GROUP)), dims)
    data, queries = cut(_assigned(data, centres, dims)), cut(_assigned(queries, groups, dims))
    plan = _plan(data, queries, centres, groups, k)
    key = ["g", "qb", "db"]
    asked_blocks = _sent(queries, plan, True).withColumn("mark", F.xxhash64("v"))
    local = asked_blocks.groupBy(*key).cogroup(_sent(data, plan, False).groupBy(*key)).applyInPandas(_solve(k), "query_id long, query long, vec_id long, high long, low long, score long")
    best = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.col("high").desc(), F.col("low").desc(), "vec_id"))
    return local.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
