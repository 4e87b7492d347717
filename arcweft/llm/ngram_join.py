"""N-gram Jaccard self-join by PartEnum signatures, and the classes of documents that its links join.

A document is the set of its distinct shingles. Sets whose Jaccard similarity reaches p percent differ in at most
d = n (100 - p) / p elements, where n is the smaller size. Sizes fall into bands (powers of two), and for each band the
domain of shingles is cut into somewhat more than d partitions (by a hash). Two similar sets differ in at most d
partitions; so if each set signs the d + 1 partitions that rank first by an order that the content of a partition
alone decides (most elements first, then the partition's number), similar sets share a signature: take the set whose last signed
partition ranks higher; it signs d + 1 partitions, one of them is equal in the other set, has the same rank there and
is signed there too. Each partition is its own subset (PartEnum with a second level of one). A set also signs in the next band if a partner
may lie there. Ranking by number of elements leaves empty and single-element partitions unsigned, which many
unrelated documents would share.

Signing one partition at a time is the member of PartEnum's family that takes the fewest signatures, d + 1: with subsets of
more than one partition (n1 parts of n2 partitions, subsets of n2 - k2 of them, n1 (k2 + 1) > d) a set has n1 C(n2, k2).

From signatures to links, exactly and without all pairs of a bucket:

1. Equal sets are one node. Signatures are sorted by value; each bucket becomes a tree, in which a node is paired with the head of
   its block of `FAN` nodes, a head with the head of the block of blocks, and all with the first node. A signature that
   a sample shows to have a large share of all rows is dealt out by node first; its parts are then joined by their heads.
2. A pair is dropped if a bound forbids it: sizes, and the distance of two small histograms of the shingles' hashes (each
   differing shingle changes one cell by one, so that the distance never exceeds the sets' difference).
3. What remains is verified on the shingles themselves, and links are joined into components.
4. In buckets that still hold more than one component, all pairs across components pass through the bound of step 2 within
   a task (large buckets in cells of `CELL` by `CELL` nodes) and only what passes is verified as in step 3.

Every pair of similar sets shares a bucket, so it is either verified or lies in one component already.

Shingles are 64-bit hashes, sets 128-bit hashes of these; nodes go by half of that, or by another hash where halves clash. A node stands
in links for the smallest doc_id that has it, so that the smallest node of a component is the class's id. Classes go back to rows by node;
nodes with more than a share of all rows meet theirs by a broadcast of at most `HOT` rows. Only words matter: documents with
fewer words than a shingle has are one shingle; documents without words and null texts are empty sets that link with nothing. Rows that
share an id are one document (their classes are joined); rows without an id take no part and get null classes. Empty tables give no rows;
only doc_id and text are read, and `deduplicated` keeps all columns whatever their names. Texts are read whole.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweft.llm.common import WORD, cut, give_back, held, remove, shared_folder, tidy
from arcweft.llm.components import components

#: Words of a shingle; similarity in percent.
WORDS, PERCENT = 5, 80
#: Nodes of a bucket that are compared at once; cells of a node's histogram; words and nodes that a worker remembers.
CELL, CELLS, KEPT, SEEN = 1024, (16, 512), 150_000, 100_000
#: Nodes that share a head in a bucket's tree, and its levels.
FAN, LEVELS = 64, 10
#: A key with more than one HOT-th of all rows (and over LEAST) is hot. One in PROBE sets shows its signatures to find hot ones.
HOT, LEAST, PROBE = 1000, 1000, 1024
#: Nodes (16 bytes each) that are sent to every task to find their texts, at most.
BROADCAST = 500_000
#: Pairs that a task gathers by their first node before it passes them on, and pairs that it compares at once.
REMEMBERED, PAIRS = 200_000, 1 << 17
#: Rows that a task gathers before it looks at them: of numbers, and of numbers with a histogram.
NUMBERS, HISTOGRAMS = 1 << 16, 1 << 13
#: What a shingle's words are, in characters; `shingles` finds the same ones in bytes of UTF-8.
FIND = re.compile(WORD).findall
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class _Words(dict):
    """Hashes of words, eight bytes each, kept up to a bound."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_digest(word)
        return h


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = x ^ np.uint64(salt)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes, these two know ASCII only: A-Z and the six white-space characters
    if not words:
        return np.empty(0, np.uint64)
    h = np.frombuffer(b"".join(map(held("shingled words", _Words).__getitem__, words)), np.uint64)
    n = min(size, len(h))
    total = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        total = _mix(total + h[k : k + len(total)], k)
    total.sort()
    return total[np.concatenate([[True], total[1:] != total[:-1]])]


def _partitions(band: int, percent: int) -> int:
    most = ((2 << band) - 1) * (100 - percent) // percent
    return max(int(1.15 * most), most) + 1 if most >= 16 else 2 * most + 6


def signatures(s: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Signatures of a set, in its own band and, where a larger partner may lie there, the next."""
    n = len(s)
    if not n:
        return np.empty(0, np.uint64)
    band, chosen = n.bit_length() - 1, n * (100 - percent) // percent + 1
    content, place = _mix(s, 101), _mix(s, 202) >> np.uint64(11)
    out = []
    for b in (band, band + 1) if n * 100 // percent >= 2 << band else (band,):
        many = _partitions(b, percent)
        part = (place % np.uint64(many)).astype(np.int64)
        count = np.bincount(part, minlength=many)
        order = np.argsort(part.astype(np.uint16) if many <= 1 << 16 else part, kind="stable")  # short numbers are sorted by radix
        value = np.zeros(many, np.uint64)
        first = np.flatnonzero(np.diff(part[order], prepend=-1))
        value[part[order][first]] = np.add.reduceat(content[order], first)
        rank = count * (many + 1) + (many - np.arange(many))
        top = np.argpartition(-rank, chosen - 1)[:chosen] if chosen < many else np.arange(many)
        out.append(_mix(value[top] + _mix(top.astype(np.uint64), b), 303))
    return np.concatenate(out)


def histogram(s: np.ndarray) -> bytes:
    """Counts (modulo 256) of the shingles by cell; twice as many cells for twice the size, within bounds."""
    cells = min(max(CELLS[0], 1 << max(len(s).bit_length() - 1, 0)), CELLS[1])
    return np.bincount((_mix(s, 404) % np.uint64(cells)).astype(np.int64), minlength=cells).astype(np.uint8).tobytes()


def may_link(one: np.ndarray, other: np.ndarray, sizes: np.ndarray, sizes_other: np.ndarray, percent: int) -> np.ndarray:
    """Whether the bounds allow a link; histograms as rows of equal length."""
    d = one - other
    apart = np.minimum(d, -d).sum(-1, dtype=np.int64)
    ok = (100 + percent) * apart <= (100 - percent) * (sizes + sizes_other)
    return ok & (100 * np.minimum(sizes, sizes_other) >= percent * np.maximum(sizes, sizes_other))


def _folded(h: bytes, cells: int) -> np.ndarray:
    return np.frombuffer(h, np.uint8).reshape(-1, cells).sum(0, dtype=np.uint8)


def _identity(s: np.ndarray) -> tuple[int, int]:
    """The two halves of the hash of a set, as signed numbers."""
    h = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def _signed(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, n, node, other, signatures, probe, histogram): the last three only where a task meets a set for the first time.

    `node` and `other` are the halves of the set's hash; `probe` repeats the signatures of one in PROBE sets.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for at in range(0, len(batch), 250):
                part = batch.iloc[at : at + 250]
                n, node, other, signed, probe, hists = [], [], [], [], [], []
                for text in part["text"]:
                    s = shingles(text, size)
                    key = _identity(s)
                    n.append(len(s))
                    node.append(key[0])
                    other.append(key[1])
                    new = len(s) > 0 and key not in seen
                    if new:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(key)
                    signed.append(signatures(s, percent).view(np.int64) if new else None)
                    probe.append(signed[-1] if new and key[1] % PROBE == 0 else None)
                    hists.append(histogram(s) if new else None)
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "n": n, "node": node, "other": other, "signatures": signed, "probe": probe, "histogram": hists})
        give_back()

    schema = "doc_id long, n long, node long, other long, signatures array<long>, probe array<long>, histogram binary"
    return docs.select("doc_id", "text").filter("doc_id is not null").mapInPandas(rows, schema)


def _gathered(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pd.DataFrame]:
    """Frames of `least` rows or more, but for the last one, whatever the session's bound of a batch, which is one for whole texts."""
    parts, many = [], 0
    for batch in batches:
        parts.append(batch)
        many += batch.num_rows
        if many >= least:
            yield pa.Table.from_batches(parts).to_pandas()
            parts, many = [], 0
    if many:
        yield pa.Table.from_batches(parts).to_pandas()


def _sent(frames: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
    for frame in frames:
        yield pa.RecordBatch.from_pandas(frame, preserve_index=False)


def _heads(index: np.ndarray) -> np.ndarray:
    """The index in its bucket of each node's parent: the head of its block, of its block of blocks, and so on."""
    out = np.zeros_like(index)
    rest, width = np.ones(len(index), bool), 1
    for _ in range(LEVELS):
        width *= FAN
        out[rest] = index[rest] // width * width
        rest &= index % width == 0
        if not rest.any():
            break
    return np.where(rest, 0, out)


def _buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From (sig, salt, node) or (sig, node) rows in order: (sig, salt, node, parent, top) of buckets with more than one node, or salted; the first is its own parent and all others' top.

    Salts over 0 mark parts of one bucket.
    """
    key0 = last0 = None  # of the bucket that the last batch ended in: (sig, salt) and its last node
    at0, heads = 0, {}  # nodes of it so far, those of them that may yet be parents by index
    widths = [FAN**k for k in range(1, LEVELS + 1)]
    for batch in batches:
        if not len(batch):
            continue
        sig, node = batch["sig"].to_numpy(), batch["node"].to_numpy()
        salt = batch["salt"].to_numpy() if "salt" in batch else None
        start = np.ones(len(sig), bool)
        start[1:] = sig[1:] != sig[:-1]
        if salt is not None:
            start[1:] |= salt[1:] != salt[:-1]
        goes_on = key0 == (sig[0], 0 if salt is None else salt[0])
        start[0] = not goes_on
        fresh = start.copy()
        fresh[1:] |= node[1:] != node[:-1]
        fresh[0] |= node[0] != last0
        if not fresh.all():
            sig, node, start, salt = sig[fresh], node[fresh], start[fresh], None if salt is None else salt[fresh]
        if not len(sig):
            continue
        if not goes_on:
            at0, heads = 0, {}
        begins = np.flatnonzero(start)  # where index 0 of each bucket lies
        if goes_on:
            begins = np.concatenate([[-at0], begins])
        place = np.flatnonzero(~start if salt is None else ~start | (salt > 0))  # most buckets have one node and are passed over
        index = place - begins[np.searchsorted(begins, place, "right") - 1]
        first, up = place - index, place - index + _heads(index)
        top, parent = node[np.maximum(first, 0)], node[np.maximum(up, 0)]
        if goes_on:
            top[first < 0] = heads[0]
            for i in np.flatnonzero(up < 0).tolist():
                parent[i] = heads[int(up[i]) + at0]
        part = np.zeros(len(place), np.int32) if salt is None else salt[place]
        second = (index == 1) & (part == 0)
        again = lambda x, y: np.concatenate([x, y[second]])  # noqa: E731  a bucket's second node brings its first one
        if len(place):
            yield pd.DataFrame({"sig": again(sig[place], sig[place]), "salt": again(part, part), "node": again(node[place], top), "parent": again(parent, top), "top": again(top, top)})
        end = len(sig) - 1 - int(begins[-1])
        spots = {end // w * w: len(sig) - 1 - end % w for w in widths}
        heads = {i: node[k] if k >= 0 else heads[i] for i, k in spots.items()}
        key0, last0, at0 = (sig[-1], 0 if salt is None else salt[-1]), node[-1], end + 1


def _bounded(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, ha, na, hb, nb) that the bounds allow, as (a, b)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cells = np.minimum(batch["ha"].map(len), batch["hb"].map(len)).to_numpy()
            keep = np.zeros(len(batch), bool)
            for c in np.unique(cells):
                i = np.flatnonzero(cells == c)
                for at in range(0, len(i), 4096):
                    k = i[at : at + 4096]
                    one, other = (np.stack([_folded(h, c) for h in batch[x].to_numpy()[k]]) for x in ("ha", "hb"))
                    keep[k] = may_link(one, other, batch["na"].to_numpy()[k], batch["nb"].to_numpy()[k], percent)
            yield batch.loc[keep, ["a", "b"]]

    return pairs.mapInPandas(rows, "a long, b long")


def _within_buckets(members: DataFrame, percent: int) -> DataFrame:
    """(a, partners) across components within each bucket that the bounds allow, but for a node with its parent and top.

    A pair that shares many buckets is named once by a task, as long as it remembers it. `members`: i, j, sig, side, node, parent, top,
    label, h, n, in order; a bucket of several cells comes as (i, j) pairs of blocks, where side tells the blocks apart.
    """

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
        """Frames of whole cells, with the rows where these begin."""
        held: list[pd.DataFrame] = []  # of the cell that goes on
        for frame in frames:
            x = pd.concat([*held, frame]) if held else frame
            key = x[["sig", "i", "j"]].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
            held = [x.iloc[starts[-1] :]]
            if len(starts) > 1:
                yield x.iloc[: starts[-1]], starts[:-1]
        if held:
            yield held[0], np.zeros(1, np.int64)

    def compared(x: pd.DataFrame, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of nodes, each smaller one first, that meet in a cell and that the bounds allow."""
        node, label, n, parent, top, side, i, j = (x[c].to_numpy() for c in ("node", "label", "n", "parent", "top", "side", "i", "j"))
        h = x["h"].to_numpy()
        cells = np.fromiter(map(len, h), np.int64, len(h))
        # a row's partners lie in a row: all after it in its cell or, where two blocks meet, the other block, which comes last
        sizes = np.diff(starts, append=len(x))
        end, other = np.repeat(starts + sizes, sizes), np.repeat(starts + sizes - np.add.reduceat(side, starts), sizes)
        begin = np.where(i == j, np.arange(len(x)) + 1, other)
        many = np.where((i != j) & (side == 1), 0, end - begin)
        upto = np.cumsum(many)
        at = 0
        while at < len(x):
            to = max(at + 1, int(np.searchsorted(upto, upto[at] - many[at] + PAIRS, "right")))
            count = many[at:to]
            one = np.repeat(np.arange(at, to), count)
            two = np.arange(len(one)) + np.repeat(begin[at:to] - (np.cumsum(count) - count), count)
            at = to
            ok = (label[one] != label[two]) & (100 * np.minimum(n[one], n[two]) >= percent * np.maximum(n[one], n[two]))
            one, two = one[ok], two[ok]
            a, b = node[one], node[two]
            ok = (a != parent[two]) & (parent[one] != b) & (a != top[two]) & (top[one] != b)
            one, two, a, b = one[ok], two[ok], np.minimum(a, b)[ok], np.maximum(a, b)[ok]
            order = np.lexsort((b, a))  # pairs that meet in several buckets are compared once
            a, b = a[order], b[order]
            fresh = np.ones(len(a), bool)
            fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            one, two, a, b = one[order[fresh]], two[order[fresh]], a[fresh], b[fresh]
            least = np.minimum(cells[one], cells[two])
            keep = np.zeros(len(a), bool)
            for c in np.unique(least):
                of_c = np.flatnonzero(least == c)
                used, where = np.unique(np.concatenate([one[of_c], two[of_c]]), return_inverse=True)
                folded, where = np.stack([_folded(x, c) for x in h[used]]), where.reshape(2, -1)
                for k in range(0, len(of_c), 4096):
                    pick, (left, right) = of_c[k : k + 4096], where[:, k : k + 4096]
                    keep[pick] = may_link(folded[left], folded[right], n[one[pick]], n[two[pick]], percent)
            yield a[keep], b[keep]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        found: dict[int, set[int]] = {}
        for x, starts in whole(_gathered(batches, HISTOGRAMS)):
            for a, b in compared(x, starts):
                for one, other in zip(a.tolist(), b.tolist(), strict=True):
                    found.setdefault(one, set()).add(other)
                if sum(map(len, found.values())) > REMEMBERED:
                    yield pd.DataFrame({"a": list(found), "partners": list(map(list, found.values()))})
                    found = {}
        if found:
            yield pd.DataFrame({"a": list(found), "partners": list(map(list, found.values()))})

    return members.mapInArrow(lambda batches: _sent(rows(batches)), "a long, partners array<long>")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b, da, db) of those of the pairs (a, b) whose sets are similar, with their nodes' documents. Only these are read again and shingled."""
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    chosen = nodes.select("node", F.col("doc").alias("doc_id"), "half", "other").join(wanted, "node", "left_semi")
    if chosen.count() <= BROADCAST:  # else the texts are dealt out to meet their ids
        chosen = F.broadcast(chosen)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 50):
                part = batch.iloc[at : at + 50]
                sets = [shingles(t, size) for t in part["text"]]
                same = np.array([_identity(s) == x for s, x in zip(sets, zip(part["half"], part["other"], strict=True), strict=True)])
                yield pd.DataFrame({"node": part["node"].to_numpy(), "doc": part["doc_id"].to_numpy(), "s": [s.view(np.int64) for s in sets]})[same]
        give_back()

    sets = docs.select("doc_id", "text").join(chosen, "doc_id").select("node", "doc_id", "half", "other", "text").mapInPandas(rows, "node long, doc long, s array<long>")
    sets = sets.dropDuplicates(["node"])  # one exchange, which both sides of the join below read
    side = lambda x: sets.select(F.col("node").alias(x), F.col("doc").alias(f"d{x}"), F.col("s").alias(f"s{x}"))
    common = F.size(F.array_intersect("sa", "sb"))  # row by row, so that only one pair of sets is in memory
    return pairs.join(side("a"), "a").join(side("b"), "b").filter((100 + percent) * common >= percent * (F.size("sa") + F.size("sb"))).select("a", "b", "da", "db")


def _nodes(signed: DataFrame) -> DataFrame:
    """node, half, other, h, n, doc, rows: one row a set; `half` and `other` are its hash, `doc` its smallest id, `rows` how many have it."""
    sets = signed.filter("n > 0").groupBy("node", "other").agg(F.first("histogram", ignorenulls=True).alias("h"), F.max("n").alias("n"), F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("rows"))
    return cut(sets.select("node", F.col("node").alias("half"), "other", "h", "n", "doc", "rows"))


def _bucketed(signed: DataFrame) -> DataFrame:
    """(sig, node, parent, top) of all buckets with more than one node; see `_buckets`."""
    shown = signed.filter("probe is not null").select(F.explode("probe").alias("sig")).groupBy("sig").agg(F.count(F.lit(1)).alias("shown"))
    total = shown.agg(F.sum("shown")).first()[0] or 0
    # parts enough for a part to be about one 100 * HOT-th of all rows; what sums up to `total` has at most 100 * HOT such signatures
    hot = shown.filter(F.col("shown") > F.lit(max(total / (100 * HOT), LEAST / 32))).select("sig", F.ceil(F.col("shown") / max(total / (100 * HOT), 1)).cast("int").alias("parts"))
    rows = signed.select("node", F.explode("signatures").alias("sig")).select("sig", "node")
    deal = lambda t: t.repartition(*t.columns[:-1]).sortWithinPartitions(*t.columns).mapInArrow(lambda rows: _sent(_buckets(_gathered(rows, NUMBERS))), "sig long, salt int, node long, parent long, top long")
    if hot.isEmpty():
        return cut(deal(rows).drop("salt"))
    salt = F.coalesce(F.pmod("node", F.col("parts")).cast("int") + 1, F.lit(0))
    found = cut(deal(rows.join(F.broadcast(hot), "sig", "left").select("sig", salt.alias("salt"), "node")))
    heads = found.filter("salt > 0 and node = parent").select("sig", "node")
    return cut(found.filter("salt = 0 or node <> parent").unionByName(deal(heads)).drop("salt"))


def classes(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of (doc_id, text); see above.

    What is written on the way (signatures of all nodes, members of shared buckets, shingles of nodes in candidate
    pairs) goes to the shared checkpoint folder; the signatures are removed when the classes are known.
    """
    if not 50 <= percent <= 100:
        raise ValueError("similarities under 50 % would reach beyond the next band")
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/signed-{uuid.uuid4().hex}"
    _signed(docs, size, percent).write.parquet(path)
    signed = spark.read.parquet(path)
    tidy(spark)
    nodes = _nodes(signed)
    clash = nodes.groupBy("node").count().filter("count > 1").select("node", F.lit(True).alias("clash"))
    total, sets = nodes.agg(F.sum("rows"), F.count(F.lit(1))).first()
    if sets > 1 and not clash.isEmpty():  # some sets in 2^64 pairs of them
        named = F.when(F.col("clash"), F.xxhash64("half", "other")).otherwise(F.col("half")).alias("node")
        nodes = cut(nodes.join(clash, "node", "left").select(named, *nodes.columns[1:]))
        signed = signed.withColumn("half", F.col("node")).join(clash, "node", "left").withColumn("node", named).drop("half", "clash")
    members = signed.select("doc_id", "n", "node")

    buckets = _bucketed(signed)
    tidy(spark)
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("h").alias(f"h{x}"), F.col("n").alias(f"n{x}"))
    ends = F.explode(F.array_distinct(F.array("parent", "top"))).alias("a")
    tied = buckets.filter("node <> parent").select(ends, F.col("node").alias("b")).distinct()
    tied = cut(_bounded(tied.join(side("a"), "a").join(side("b"), "b"), percent))
    links = _verified(tied, nodes, docs, size, percent).select(F.col("da").alias("a"), F.col("db").alias("b"))
    # ids with several sets tie the sets' documents
    several = members.filter("n > 0").groupBy("doc_id").agg(F.min("node").alias("_low"), F.max("node").alias("_high")).filter("_low <> _high").select("doc_id")
    same_id = members.join(several, "doc_id", "left_semi").distinct().join(nodes.select("node", "doc"), "node").select(F.col("doc_id").alias("a"), F.col("doc").alias("b"))
    labels = components(links.unionByName(same_id))
    tidy(spark)

    label = nodes.select("node", "doc").join(labels.withColumnRenamed("node", "doc"), "doc").select("node", F.col("root").alias("label"))
    labelled = buckets.join(label, "node", "left").join(nodes.select("node", "doc"), "node").select("sig", "node", "parent", "top", F.coalesce("label", "doc").alias("label"))
    mixed = labelled.groupBy("sig").agg(F.min("label").alias("_low"), F.max("label").alias("_high"), F.count(F.lit(1)).alias("_n")).filter("_low <> _high and _n > 2")
    rest = labelled.join(mixed.select("sig", F.col("_low").alias("low"), F.ceil(F.col("_n") / CELL).cast("int").alias("_blocks")), "sig").join(nodes.select("node", "h", "n"), "node")
    block = F.pmod(F.col("node"), F.col("_blocks")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda k: F.struct(F.least(block, k).alias("i"), F.greatest(block, k).alias("j")))
    rest = rest.withColumn("_cell", F.explode(cells)).select("low", "_blocks", F.col("_cell.i").alias("i"), F.col("_cell.j").alias("j"), "sig", ((F.col("_cell.i") != F.col("_cell.j")) & (block == F.col("_cell.j"))).cast("int").alias("side"), "node", "parent", "top", "label", "h", "n")
    cell = ["low", "_blocks", "i", "j"]  # cells of buckets that hold the same class meet, as they mostly hold the same pairs
    rest = rest.repartition(*cell).sortWithinPartitions(*cell, "sig", "side")
    more = cut(_within_buckets(rest, percent).select("a", F.explode("partners").alias("b")).distinct())
    root = lambda x: labels.select(F.col("node").alias(f"d{x}"), F.col("root").alias(f"r{x}"))
    between = _verified(more, nodes, docs, size, percent).join(root("a"), "da", "left").join(root("b"), "db", "left").select(F.coalesce("ra", "da").alias("a"), F.coalesce("rb", "db").alias("b"))
    joined = components(between)
    tidy(spark)

    of_doc = labels.withColumnRenamed("root", "_root").join(joined.select(F.col("node").alias("_root"), "root"), "_root", "left").select(F.col("node").alias("doc"), F.coalesce("root", "_root").alias("component_id"))
    of_doc = of_doc.unionByName(joined.join(labels, "node", "left_anti").select(F.col("node").alias("doc"), F.col("root").alias("component_id")))
    of_node = cut(nodes.select("node", "doc", "rows").join(of_doc, "doc", "left").select("node", "rows", F.coalesce("component_id", "doc").alias("component_id")))  # read three times below
    tidy(spark)
    hot = F.col("rows") > F.lit(max((total or 0) / HOT, LEAST))  # at most HOT nodes
    own, few, lookup = members.filter("n > 0"), F.broadcast(of_node.filter(hot).drop("rows")), of_node.filter(~hot).drop("rows")
    out = own.join(few, "node").unionByName(own.join(few.select("node"), "node", "left_anti").join(lookup, "node")).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = members.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    texts = F.when(F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)) == 0, 0)
    without = docs.filter("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), texts.cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    found = cut(out.unionByName(empty).unionByName(without))
    remove(spark, path)
    tidy(spark)
    return found


def deduplicated(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each class of `docs`: the one with the smallest id. Documents without words or id all stay."""
    found = classes(docs, size, percent)
    gone = found.filter("component_id <> doc_id").select("doc_id").distinct()
    again = found.filter("component_id = doc_id and n_shingles > 0").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    kept = docs.join(gone, "doc_id", "left_anti")
    once = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(again, "doc_id", "left_anti").unionByName(once).select(*[F.col(f"`{c}`") for c in docs.columns])
