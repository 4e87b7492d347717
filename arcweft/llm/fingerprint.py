"""Document fingerprints: a homomorphic multiset hash over paragraphs. [native]

A text is taken as the multiset of its paragraphs (runs between line feeds, empty ones included) and each paragraph as
the multiset of its sentences. Every paragraph is hashed to four 64-bit words, cut into eight lanes of 31 and 30 bits;
every sentence is hashed to 128 lanes of one bit. A fingerprint is the lane-wise sum of these wide vectors, modulo
2^31 and 2^30, so

* equal texts have equal fingerprints, whatever the order of their paragraphs;
* adding or removing a paragraph adds or subtracts its vector (`combine`), without the rest of the text.

Taken as signs (1 and -1), the sentence lanes are random projections of the sentence counts: the squared distance of two
fingerprints estimates how many sentences differ, hence `likeness`. It is 1 for equal fingerprints and about 0 (deviation
0.09) for texts that share no sentence. Sentence lanes count modulo 2^30, more sentences than a text can hold; likeness
of fingerprints that `combine` has brought beyond that is undefined. Runs of `RUN` sentences are summed in narrow lanes.

Nulls count as empty texts; empty tables give no rows; other columns are kept by `fingerprints` and not read by
`beside_next`. All sums are masked as they go, so that no text is too long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweft.llm.common import ranked

#: Two lanes of 31 and 30 bits a long; two lanes of 30 bits a long, of sentences.
WIDE, FIELDS = 0x3FFFFFFF7FFFFFFF, 0x3FFFFFFF3FFFFFFF
#: Within a run of sentences: four lanes of 16 bits a long, one bit of each set by a sentence; every other lane; sentences that fit.
ONES, APART, RUN = 0x0001000100010001, 0x0000FFFF0000FFFF, 0x7FFF
WIDE_LONGS, SHIFTS, SALTS = 4, 16, 2
LONGS = WIDE_LONGS + 2 * SALTS * SHIFTS
SENTENCE_END = r"(?<=[.!?])[ \t]+|\n"


def lanes(text: Column) -> Column:
    """The fingerprint of a text as array<long>: 4 longs of paragraph lanes, 64 of sentence lanes, the sentence count."""
    text = F.coalesce(text, F.lit(""))

    def paragraph(total: Column, p: Column) -> Column:
        return F.array(*[(total[i] + F.xxhash64(p, F.lit(i)).bitwiseAND(F.lit(WIDE))).bitwiseAND(F.lit(WIDE)) for i in range(WIDE_LONGS)])

    def sentence(total: Column, h: Column) -> Column:
        return F.array(*[total[k * SHIFTS + j] + F.shiftright(h[k], j).bitwiseAND(F.lit(ONES)) for k in range(SALTS) for j in range(SHIFTS)])

    def run(total: Column, narrow: Column) -> Column:
        low = [narrow[i].bitwiseAND(F.lit(APART)) for i in range(SALTS * SHIFTS)]
        high = [F.shiftright(narrow[i], 16).bitwiseAND(F.lit(APART)) for i in range(SALTS * SHIFTS)]
        return F.array(*[(total[i] + x).bitwiseAND(F.lit(FIELDS)) for i, x in enumerate(low + high)])

    def runs(hashes: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(hashes), F.lit(1)), F.lit(RUN))
        return F.transform(starts, lambda at: F.aggregate(F.slice(hashes, at, RUN), zeros(SALTS * SHIFTS), sentence))

    sentences = F.filter(F.split(text, SENTENCE_END), lambda s: s != "")
    hashes = F.transform(sentences, lambda s: F.array(*[F.xxhash64(s, F.lit(100 + k)) for k in range(SALTS)]))
    zeros = lambda n: F.array(*[F.lit(0).cast("long")] * n)
    wide = F.aggregate(F.split(text, "\n"), zeros(WIDE_LONGS), paragraph)
    narrow = F.flatten(F.transform(F.array(hashes), runs))  # by way of an array, so that a text is split and hashed once and not once a run
    return F.concat(wide, F.aggregate(narrow, zeros(2 * SALTS * SHIFTS), run), F.array(F.size(sentences).cast("long")))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of both multisets together, or with sign=-1 of `a` without `b`, from the fingerprints alone."""

    def mask(i: Column) -> Column:
        return F.when(i < WIDE_LONGS, F.lit(WIDE)).when(i < LONGS, F.lit(FIELDS)).otherwise(F.lit(0x3FFFFFFFFFFFFFFF))

    # the lowest bit above each lane keeps a borrow from reaching the next lane
    if sign > 0:
        return F.transform(a, lambda x, i: (x + b[i]).bitwiseAND(mask(i)))
    guard = lambda i: F.when(i < WIDE_LONGS, F.lit(0x4000000080000000)).when(i < LONGS, F.lit(0x4000000040000000)).otherwise(F.lit(0))
    return F.transform(a, lambda x, i: (x.bitwiseOR(guard(i)) - b[i]).bitwiseAND(mask(i)))


def text_of(fingerprint: Column) -> Column:
    """Lane longs as lowercase hexadecimal text, 16 digits each."""
    return F.lower(F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: twice the product of the sign sums over the sum of their squares; 1 if the fingerprints are equal."""
    field = lambda x, k: F.shiftright(x, 32 * k).bitwiseAND(F.lit(0x3FFFFFFF))
    lifted = lambda d: (d + (1 << 29)).bitwiseAND(F.lit(0x3FFFFFFF)) - (1 << 29)

    def squares(one: Column, other: Column | None) -> Column:
        count = one[LONGS] - (other[LONGS] if other is not None else F.lit(0))
        total = F.lit(0).cast("double")

        def add(acc: Column, i: Column) -> Column:
            for k in range(2):
                d = field(one[i], k) - (field(other[i], k) if other is not None else F.lit(0))
                if other is not None:
                    d = lifted(d)
                v = (2 * d - count).cast("double")
                acc = acc + v * v
            return acc

        return F.aggregate(F.sequence(F.lit(WIDE_LONGS), F.lit(LONGS - 1)), total, add)

    both = squares(a, None) + squares(b, None)
    part = F.when(both > 0, 1 - squares(a, b) / both).otherwise(0.0)
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), part)))


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Add the fingerprint (array<long>) of every row's text; one row in, one row out, no exchange."""
    return docs.withColumn(name, lanes(F.col(text)))


def beside_next(docs: DataFrame) -> DataFrame:
    """Per row of (doc_id, text): its text, the edited text and the fingerprint of the next document in ascending doc_id.

    The edited text has the last floor(n/2) code points replaced by the first as many (or all) of the next document's;
    after the last comes the first. Ids are put in order on slim rows (nulls last, equal ids by a hash of their text);
    rows that repeat id and text count as one document there and each get the same result. Texts move twice: once to
    be looked up as the next document, of which only the needed head goes on, once to meet that head.
    """
    key = [F.coalesce(F.col("doc_id"), F.lit(-(2**63)).cast("long")).alias("_k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_t")]
    base = docs.select(F.coalesce("text", F.lit("")).alias("text"), *key)  # the same columns for both joins, so that they share an exchange
    slim = docs.groupBy(*key).agg(F.max(F.length(F.coalesce("text", F.lit("")))).alias("_n"), F.max(F.col("doc_id").isNull()).alias("_null"))
    order = ranked(slim, ["_null", "_k", "_t"])
    total = max(order.count(), 1)
    here = order.select("_k", "_t", "_null", F.floor(F.col("_n") / 2).cast("int").alias("_need"), ((F.col("rank") + 1) % total).alias("_next"))
    there = order.select(F.col("rank").alias("_next"), F.col("_k").alias("_nk"), F.col("_t").alias("_nt"))
    wanted = here.join(there, "_next").select(F.col("_k").alias("_fk"), F.col("_t").alias("_ft"), "_null", "_need", F.col("_nk").alias("_k"), F.col("_nt").alias("_t"))
    heads = base.join(wanted, ["_k", "_t"]).select(F.col("_fk").alias("_k"), F.col("_ft").alias("_t"), "_null", F.expr("left(text, _need)").alias("_head"), lanes(F.col("text")).alias("next_fingerprint"))
    heads = heads.groupBy("_k", "_t").agg(F.first("_null").alias("_null"), F.first("_head").alias("_head"), F.first("next_fingerprint").alias("next_fingerprint"))
    kept = F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))")
    return base.join(heads, ["_k", "_t"]).select(F.when(~F.col("_null"), F.col("_k")).alias("doc_id"), "text", F.concat(kept, F.col("_head")).alias("edited"), "next_fingerprint")
