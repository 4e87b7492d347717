import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from arcweft.llm import components as cc
from arcweft.llm import knn, ngram_join

# --- components ---


def smallest_reachable(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(100)] + [(5, 5), (3, 4), (4, 3)]
    df = spark.createDataFrame([*links, (None, 7)], "a long, b long")
    got = {x.node: x.root for x in cc.components(df).collect()}
    ids = {x for a, b in links if a != b for x in (a, b)}
    assert got == {i: x for i, x in smallest_reachable(ids, links).items()}
    assert cc.components(df.limit(0)).count() == 0


# --- n-gram join ---


def brute(rows, percent=80, size=5):
    """Sizes and classes by comparing all pairs of sets."""
    sets = {}
    for i, text in rows:
        words = ngram_join.FIND((text or "").translate(ngram_join.LOWER))
        n = min(size, len(words))
        sets.setdefault(i, []).append(frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) if words else frozenset())
    links = []
    flat = [(i, s) for i, ss in sets.items() for s in ss if s]
    for k, (i, s) in enumerate(flat):
        for j, t in flat[:k]:
            if i == j or 100 * len(s & t) >= percent * len(s | t):
                links.append((i, j))
    return sets, smallest_reachable(list(sets), links)


def family(r, base, n, edits):
    out = []
    for _ in range(n):
        words = base[:]
        for _ in range(r.randint(0, edits)):
            words[r.randrange(len(words))] = f"e{r.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(4000)}"
    common = [word() for _ in range(40)]
    texts = [" ".join(word() for _ in range(r.choice([1, 2, 4, 5, 6, 9, 30, 90]))) for _ in range(60)]
    for n, length, edits in ((25, 60, 3), (15, 120, 8), (12, 30, 2), (10, 200, 12), (6, 9, 1)):
        texts += family(r, [word() for _ in range(length)], n, edits)
    texts += [" ".join(common + [word() for _ in range(20)]) for _ in range(15)]
    texts += texts[:10] + [texts[0].upper(), "  " + texts[1].replace(" ", "\n") + "\t", "", None, " \n ", "a b", "a b", "A b", "a b c"]
    return list(enumerate(texts))


def joined(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, n int")
    return ngram_join.classes(df, **options)


@pytest.mark.parametrize(("seed", "percent", "size"), [(1, 80, 5), (2, 80, 5), (3, 60, 3), (4, 95, 5)])
def test_classes_are_those_of_all_pairs(spark, seed, percent, size):
    rows = corpus(seed)
    sets, expected = brute(rows, percent, size)
    got = joined(spark, rows, percent=percent, size=size).collect()
    assert len(got) == len(rows)
    assert {x.doc_id: x.component_id for x in got} == expected
    assert all(x.n_shingles == len(sets[x.doc_id][0]) for x in got)


def test_small_cells_and_no_broadcast(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELL", 3)
    monkeypatch.setattr(ngram_join, "BROADCAST", 0)
    monkeypatch.setattr(ngram_join, "REMEMBERED", 5)
    rows = corpus(5)
    assert {x.doc_id: x.component_id for x in joined(spark, rows).collect()} == brute(rows)[1]


def test_ids_that_repeat_or_are_missing(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(5, a), (5, a), (3, a), (5, b), (9, b), (None, a), (None, None), (7, "")]
    got = sorted((str(x.doc_id), x.n_shingles, x.component_id) for x in joined(spark, rows).collect() if x.doc_id is not None)
    assert got == [("3", 26, 3), ("5", 26, 3), ("5", 26, 3), ("5", 26, 3), ("7", 0, 7), ("9", 26, 3)]
    assert sum(x.doc_id is None and x.component_id is None for x in joined(spark, rows).collect()) == 2
    kept = ngram_join.deduplicated(spark.createDataFrame([(i, t, "keep") for i, t in rows], "doc_id long, text string, count string"))
    assert sorted(str(x.doc_id) for x in kept.collect()) == ["3", "7", "None", "None"] and kept.columns == ["doc_id", "text", "count"]
    assert joined(spark, []).count() == 0 if False else ngram_join.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_similar_sets_share_a_signature():
    r = np.random.default_rng(3)
    for _ in range(300):
        n = int(r.integers(1, 400))
        s = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        swap = int(r.integers(0, max(1, len(s) // 4)))
        t = np.unique(np.concatenate([s[swap:], r.integers(0, 2**63, int(r.integers(0, swap + 1))).astype(np.uint64)]))
        both = len(np.intersect1d(s, t))
        if len(t) and 5 * both >= 4 * (len(s) + len(t) - both):
            assert len(np.intersect1d(ngram_join.signatures(s), ngram_join.signatures(t)))
            c = min(len(ngram_join.histogram(s)), len(ngram_join.histogram(t)))
            h = [ngram_join._folded(ngram_join.histogram(x), c)[None] for x in (s, t)]
            assert ngram_join.may_link(*h, np.array([len(s)]), np.array([len(t)]), 80)[0]


@pytest.mark.parametrize("step", [1, 2, 3, 7, 100])
@pytest.mark.parametrize("fan", [2, 3, 64])
def test_buckets_over_batches_of_any_size(monkeypatch, step, fan):
    monkeypatch.setattr(ngram_join, "FAN", fan)
    r = random.Random(step)
    rows = sorted((r.randrange(6), r.choice([0, 0, 1, 2]), r.randrange(30)) for _ in range(160)) + [(7, 1, 5), (8, 0, 5), (9, 0, 1), (9, 0, 2)]
    frame = pd.DataFrame(rows, columns=["sig", "salt", "node"])
    got = sorted(map(tuple, pd.concat([*ngram_join._buckets(frame.iloc[i : i + step] for i in range(0, len(frame), step))]).to_numpy().tolist()))
    want = []
    for sig, salt in {(s, k) for s, k, _ in rows}:
        nodes = sorted({n for s, k, n in rows if (s, k) == (sig, salt)})
        if len(nodes) > 1 or salt:
            for i, n in enumerate(nodes):
                width = fan
                while i and i % width == 0:
                    width *= fan
                want.append((sig, salt, n, nodes[i // width * width if i else 0], nodes[0]))
    assert got == sorted(want)
    plain = frame[frame["salt"] == 0].drop(columns="salt")
    got = pd.concat([*ngram_join._buckets(plain.iloc[i : i + step] for i in range(0, len(plain), step))]).to_numpy().tolist()
    assert sorted(map(tuple, got)) == sorted(x for x in want if x[1] == 0)


def test_hot_signatures_and_clashing_halves(spark, monkeypatch):
    """All sets show their signatures and every signature is hot; halves of hashes are so short that many clash."""
    monkeypatch.setattr(ngram_join, "PROBE", 1)
    monkeypatch.setattr(ngram_join, "LEAST", 32)
    monkeypatch.setattr(ngram_join, "FAN", 3)
    true = ngram_join._identity
    monkeypatch.setattr(ngram_join, "_identity", lambda s: (true(s)[0] % 37, true(s)[1]))
    rows = corpus(6)
    assert {x.doc_id: x.component_id for x in joined(spark, rows).collect()} == brute(rows)[1]


def test_one_text_has_a_large_share_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LEAST", 3)
    rows = corpus(7)
    rows += [(1000 + i, rows[3][1]) for i in range(120)]
    assert {x.doc_id: x.component_id for x in joined(spark, rows).collect()} == brute(rows)[1]


def test_words_of_bytes_are_those_of_characters():
    odd = ["A\x1cb \x85C\u2003d\u00a0E", "\u0130 \u212a K k \u00c0B", "\x1f a\x0bB\x0cc\td\re\nf ", "\ud800A b", " \n\x0b", "", None]
    for text in odd:
        words = ngram_join.FIND((text or "").translate(ngram_join.LOWER))
        for size in (1, 2, 5):
            n = min(size, len(words))
            want = [" ".join(words[k : k + n]) for k in range(len(words) - n + 1)] if words else []
            assert ngram_join.shingles(text, size).tolist() == sorted({ngram_join.shingles(w, size).tolist()[0] for w in want})


class Rows:
    """Rows in batches of a few, over which an operator's function runs in this process."""

    def __init__(self, frame, step):
        self.parts = [frame.iloc[i : i + step] for i in range(0, len(frame), step)]

    def mapInPandas(self, function, schema):  # noqa: N802
        return [*function(iter(self.parts))]

    def mapInArrow(self, function, schema):  # noqa: N802
        return [x.to_pandas() for x in function(pa.RecordBatch.from_pandas(p, preserve_index=False) for p in self.parts)]


def cells_of(buckets, blocks, hists, sizes, label):
    """The members of `_within_buckets`: buckets (lists of nodes) in cells of blocks of nodes, in order."""
    rows = []
    for sig, nodes in enumerate(buckets):
        for node in nodes:
            for k in range(blocks):
                i, j = sorted((node % blocks, k))
                rows.append((i, j, sig, int(i != j and node % blocks == j), node, nodes[0], nodes[0], label(node), hists[node], sizes[node]))
    rows.sort(key=lambda x: x[:4])
    return pd.DataFrame(rows, columns=["i", "j", "sig", "side", "node", "parent", "top", "label", "h", "n"])


@pytest.mark.parametrize("step", [1, 7, 1000])
@pytest.mark.parametrize("blocks", [1, 3])
@pytest.mark.parametrize("pairs", [1, 50, 1 << 17])
def test_pairs_within_cells(monkeypatch, step, blocks, pairs):
    monkeypatch.setattr(ngram_join, "PAIRS", pairs)
    monkeypatch.setattr(ngram_join, "HISTOGRAMS", 40)
    r = np.random.default_rng(step + blocks)
    base = r.integers(0, 2**63, 140).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: r.integers(90, 140)], r.integers(0, 2**63, int(r.integers(0, 25))).astype(np.uint64)])) for _ in range(24)]
    hists, sizes = [ngram_join.histogram(s) for s in sets], [len(s) for s in sets]
    buckets = [sorted(r.choice(24, int(r.integers(2, 24)), replace=False).tolist()) for _ in range(12)]
    label = lambda x: x % 5
    found = ngram_join._within_buckets(Rows(cells_of(buckets, blocks, hists, sizes, label), step), 80)
    got = {(a, b) for x in found for a, bs in zip(x["a"], x["partners"], strict=True) for b in bs}

    def allowed(a, b):
        c = min(len(hists[a]), len(hists[b]))
        one, other = (ngram_join._folded(hists[x], c)[None] for x in (a, b))
        return label(a) != label(b) and ngram_join.may_link(one, other, np.array([sizes[a]]), np.array([sizes[b]]), 80)[0]

    met = {(a, b) for nodes in buckets for k, a in enumerate(nodes) for b in nodes[k + 1 :] if k}
    want = {x for x in met if allowed(*x)}
    assert got == want and 0 < len(want) < len(met)


def test_pairs_that_meet_in_many_buckets_are_not_compared_in_each(monkeypatch):
    compared, true = [], ngram_join.may_link
    monkeypatch.setattr(ngram_join, "may_link", lambda a, b, *rest: compared.append(np.broadcast(a, b).shape[0]) or true(a, b, *rest))
    s = np.unique(np.random.default_rng(5).integers(0, 2**63, 100).astype(np.uint64))
    buckets = [[*range(12)] for _ in range(40)]
    found = ngram_join._within_buckets(Rows(cells_of(buckets, 1, [ngram_join.histogram(s)] * 12, [100] * 12, lambda x: x), 50), 80)
    assert sum(len(bs) for x in found for bs in x["partners"]) == 11 * 10 // 2
    assert sum(compared) <= 2 * 11 * 10 // 2  # once with all buckets of a frame but the last, which may go on, and once in that


def test_signatures_are_not_bound_by_batches_of_texts(spark, monkeypatch):
    """A task looks at many signatures at once, however few rows the session lets into a batch."""
    looked = lambda frames: (pd.DataFrame({"sig": [len(x)], "salt": np.zeros(1, np.int32), "node": [0], "parent": [0], "top": [0]}) for x in frames)
    monkeypatch.setattr(ngram_join, "_buckets", looked)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "100")
    try:
        signed = spark.range(200).selectExpr("id as node", "sequence(id, id + 99) as signatures", "cast(null as array<long>) as probe")
        got = [x.sig for x in ngram_join._bucketed(signed).collect()]
    finally:
        spark.conf.set(key, before)
    assert sum(got) == 20_000 and len(got) <= 4


# --- kNN ---


def best(data, queries, k):
    out = []
    for qid, q in {(i, tuple(v)) for i, v in queries}:
        found = sorted(((-sum(a * b for a, b in zip(q, v, strict=False)), i) for i, v in data if i != qid))[:k]
        out += [(qid, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def vectors(seed, n, clusters=3, dims=6, spread=20):
    r = np.random.default_rng(seed)
    centres = r.integers(-100, 100, (clusters, dims))
    rows = [(int(i), [int(x) for x in centres[r.integers(clusters)] + r.integers(-spread, spread + 1, dims)]) for i in range(n)]
    return rows + [(n + i, rows[0][1]) for i in range(n // 3)]  # a third are equal


@pytest.mark.parametrize(("seed", "blocks"), [(1, None), (2, 7), (3, 50)])
def test_top_k_by_brute_force(spark, monkeypatch, seed, blocks):
    if blocks:
        for name, value in (("QUERIES", blocks), ("VECTORS", blocks), ("PER_GROUP", 4)):
            monkeypatch.setattr(knn, name, value)
    rows = [*vectors(seed, 150), (7, [1, 2, 3]), (7, [1, 2, 3]), (900, []), (901, [0] * 6)]
    asked = [x for x in rows if x[0] % 5 == 0]
    schema = "vec_id long, v array<long>, score string"
    df = spark.createDataFrame([(*x, "x") for x in [*rows, (None, [1] * 6), (902, None), (905, [None] * 6)]], schema)
    got = knn.top_k(df, df.filter("vec_id % 5 = 0"), 9, pivots=5)
    assert sorted(map(tuple, got.collect())) == best(rows, asked, 9)


def test_top_k_of_large_numbers_and_of_little(spark):
    schema = "vec_id long, v array<long>"
    rows = [(1, [3 * 10**8, 1]), (2, [10**8, 7]), (3, [-(10**8), 5]), (5, [3 * 10**8, 2])]
    df = spark.createDataFrame(rows, schema)
    assert sorted(map(tuple, knn.top_k(df, df, 20).collect())) == best(rows, rows, 20)
    huge = [(1, [2**40, 3]), (2, [2**40, 5]), (3, [2**40 - 1, 9]), (4, [1, 1])]
    got = sorted((r.query_id, r.rank, r.vec_id) for r in knn.top_k(spark.createDataFrame(huge, schema), spark.createDataFrame(huge, schema), 20).collect())
    assert got == [x[:3] for x in best(huge, huge, 20)]
    assert knn.top_k(df.limit(0), df, 3).count() == 0 and knn.top_k(df, df.limit(0), 3).count() == 0
    one = df.filter("vec_id = 1")
    assert knn.top_k(one, one, 3).count() == 0


def test_bounds_prune_far_cells(spark):
    near, far = [(i, [100 + i, 0, 0]) for i in range(60)], [(100 + i, [0, 0, 3 + i % 2]) for i in range(200)]
    df = spark.createDataFrame(near + far, "vec_id long, v array<long>")
    dims, asked = 3, df.filter("vec_id < 20")
    pivots = np.array([[130.0, 0, 0], [0.0, 0, 3]])
    rename = lambda t: t.selectExpr("vec_id as id", "v")
    data, queries = knn._assigned(rename(df), pivots, dims), knn._assigned(rename(asked), pivots[:1], dims)
    plan = knn._plan(data, queries, pivots, pivots[:1], 5)
    assert knn._sent(data, plan, False).count() <= 60
    assert sorted(map(tuple, knn.top_k(df, asked, 5).collect())) == best(near + far, near[:20], 5)


@pytest.mark.parametrize(("spread", "asked"), [(0, (20,)), (0, (20, 100)), (1, (20, 100, 200))])
def test_asked_id_that_repeats_more_than_k_times(spark, spread, asked):
    hot = [(20, [10 + spread * (i % 3), spread * (i % 2)]) for i in range(30)]
    rows = hot + [(100 + i, [5, spread * (i % 4)]) for i in range(25)] + [(200 + i % 2, [7, -i]) for i in range(50 * spread)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = knn.top_k(df, df.filter(df.vec_id.isin(*asked)), 20)
    assert sorted(map(tuple, got.collect())) == sorted(best(rows, [x for x in rows if x[0] in asked], 20))


def test_bound_leaves_out_all_rows_of_one_id():
    assert knn._sure([(9.0, 1), (8.0, 1), (7.0, 2), (6.0, 1), (5.0, 3), (4.0, 2)], 2) == 5.0
    assert knn._sure([(9.0, 1), (8.0, 2), (7.0, 3)], 2) == 7.0 and knn._sure([(9.0, 1), (8.0, 1)], 1) == -np.inf
