"""Byte-level BPE encoding and decoding with a public tokenizer file.

A text is cut at the file's added tokens and then by the byte-level pattern into pieces; within a piece, the merges are
found with a segment tree over the ranks of adjacent pairs. Its root names the leftmost pair of the lowest rank; a merge
changes three leaves (the pair itself, the one before, the one that is gone), each in as many steps as the tree is deep, so
a piece of n bytes takes O(n log n) whatever its length. Pieces repeat, so their ids are kept in a table of bounded size.

Encoded texts are binary: ids as little-endian unsigned 32-bit integers, one after the other (`as_array` unpacks them).
Null texts count as empty; empty texts have no ids. Texts are encoded whole, of whatever length. Rows are independent, whatever repeats; empty tables give no rows; other columns stay. Ids that the file does
not know are a decoding error; bytes that are no UTF-8 decode to replacement characters, as the library does it.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweft.llm.common import free_name, give_back, held

#: Fixed value: the byte-level split pattern that tokenizer files of this kind imply.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose ids a worker keeps: two generations of this many.
KEPT = 1 << 17
#: Rows that are encoded and decoded before they go back to Spark.
SLICE = 250
#: Rank of a pair that has no merge; bits for the position in a leaf, of long pieces and of those whose leaves stay small.
NEVER, SHIFT, SHORT = (1 << 17) - 1, 40, 12


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in tokenizer files: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class RankTree:
    """Minimum of (rank, position) over the pairs of a piece; leaves change one at a time, `node[1]` is the root."""

    __slots__ = ("node", "width")

    def __init__(self, leaves: list[int], never: int):
        self.width = width = 1 << (len(leaves) - 1).bit_length()
        node = leaves + [never] * (width - len(leaves))
        level = node
        while len(level) > 1:  # from the leaves to the root, each level before the one below it
            level = [a if a < b else b for a, b in zip(level[::2], level[1::2])]
            node = level + node
        self.node = [never, *node]

    def set(self, leaf: int, value: int) -> None:
        node, i = self.node, leaf + self.width
        while i:
            if node[i] == value:
                return
            node[i] = value
            other = node[i ^ 1]
            if other < value:
                value = other
            i >>= 1


class Tokenizer:
    """A byte-level BPE tokenizer from the text of its file."""

    def __init__(self, text: str):
        file = json.loads(text)
        model = file["model"]
        symbols = byte_symbols()
        back = {s: b for b, s in symbols.items()}
        ids = model["vocab"]
        self.first = [ids[symbols[b]] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}  # by pair of ids: rank and merged id
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        if len(model["merges"]) >= NEVER:
            raise ValueError("more merges than ranks")
        self.bytes = {i: bytes(back[c] for c in s) for s, i in ids.items()}
        self.added = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        self.bytes |= {i: s.encode() for s, i in self.added.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pieces = regex.compile(PATTERN).findall
        self.young = _Pieces(self)

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece, by merges over a segment tree."""
        part, n, get = [self.first[b] for b in piece], len(piece), self.merges.get
        if n < 2:
            return part
        shift = SHORT if n < 1 << SHORT else SHIFT
        low, never = (1 << shift) - 1, NEVER << shift
        leaves, i = [], 0
        for pair in zip(part, part[1:]):
            m = get(pair)
            leaves.append(never if m is None else m[0] << shift | i)
            i += 1
        tree = RankTree(leaves, never)
        node, put, after, before = tree.node, tree.set, list(range(1, n + 1)), list(range(-1, n - 1))
        while (least := node[1]) < never:
            i = least & low
            gone = after[i]
            part[i] = one = get((part[i], part[gone]))[1]
            part[gone] = -1
            after[i] = follow = after[gone]
            if follow < n:
                put(gone, never)
                before[follow] = i
                m = get((one, part[follow]))
                put(i, never if m is None else m[0] << shift | i)
            else:  # the pair was the last one; its second part has no pair of its own
                put(i, never)
            p = before[i]
            if p >= 0:
                m = get((part[p], one))
                put(p, never if m is None else m[0] << shift | p)
        return [x for x in part if x >= 0]

    def encode(self, text: str) -> bytes:
        """Packed ids of a whole text."""
        if self.cut is None or not any(a in text for a in self.added):
            return b"".join(map(self.young.__getitem__, self.pieces(text)))
        spans = self.cut.split(text)
        return b"".join(struct.pack("<I", self.added[s]) if i % 2 else b"".join(map(self.young.__getitem__, self.pieces(s))) for i, s in enumerate(spans))

    def decode(self, packed: bytes) -> str:
        """The text of packed ids."""
        ids = memoryview(packed).cast("I") if struct.pack("=I", 1) == struct.pack("<I", 1) else struct.unpack(f"<{len(packed) // 4}I", packed)
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


class _Pieces(dict):
    """Packed ids by piece; when a generation is full it becomes the old one, and what is used again moves on."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer, self.old = tokenizer, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            ids = self.tokenizer.encode_piece(piece.encode("utf-8", "surrogatepass"))
            found = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:  # longer ones hardly repeat
            if len(self) >= KEPT:
                self.old = dict(self)
                self.clear()
            self[piece] = found
        return found


def _tokenizer(shared) -> Tokenizer:  # noqa: ANN001
    return held(("bpe", shared.id), lambda: Tokenizer(shared.value))


class Codec:
    """Column functions of one tokenizer file; the driver reads the file (some MB), executors get it as a broadcast."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, encoding="utf-8") as f:
            text = f.read()
        self.shared = shared = _Shared(spark.sparkContext.broadcast(text))

        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                one = _tokenizer(shared).encode
                yield pd.Series([one(t or "") for t in texts], dtype=object)

        def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for packed in batches:
                one = _tokenizer(shared).decode
                yield pd.Series([one(p or b"") for p in packed], dtype=object)

        def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in batches:
                tokenizer = _tokenizer(shared)
                for i in range(0, len(texts), SLICE):
                    packed = [tokenizer.encode(t or "") for t in texts.iloc[i : i + SLICE]]
                    yield pd.DataFrame({"ids": packed, "decoded": [tokenizer.decode(p) for p in packed]})
            give_back()

        self._encode = F.pandas_udf(encode, "binary", F.PandasUDFType.SCALAR_ITER)
        self._decode = F.pandas_udf(decode, "string", F.PandasUDFType.SCALAR_ITER)
        self._both = F.pandas_udf(both, "ids binary, decoded string", F.PandasUDFType.SCALAR_ITER)

    def encode(self, docs: DataFrame, text: str = "text", name: str = "ids") -> DataFrame:
        return docs.withColumn(name, self._encode(F.col(text)))

    def decode(self, docs: DataFrame, ids: str = "ids", name: str = "decoded") -> DataFrame:
        return docs.withColumn(name, self._decode(F.col(ids)))

    def round_trip(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """`docs` with ids and decoded (in place of columns of these names), the text that the ids decode to, by one Python worker a task."""
        held_in = free_name(docs, "both")
        out = docs.withColumn(held_in, self._both(F.col(text)))
        return out.withColumns({"ids": F.col(f"{held_in}.ids"), "decoded": F.col(f"{held_in}.decoded")}).drop(held_in)


class _Shared:
    """A broadcast with an id that is the same in every task."""

    def __init__(self, broadcast):  # noqa: ANN001
        self.broadcast, self.id = broadcast, hash(broadcast.value)

    @property
    def value(self) -> str:
        return self.broadcast.value


def as_array(packed: Column) -> Column:
    """array<long> of packed ids."""
    byte = lambda i, k: F.substring(F.hex(packed), 8 * i + 2 * k + 1, 2)
    one = lambda i: F.conv(F.concat(byte(i, 3), byte(i, 2), byte(i, 1), byte(i, 0)), 16, 10).cast("long")
    count = (F.length(packed) / 4).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), one)).otherwise(F.array().cast("array<bigint>"))
