import hashlib
import random
import re
from fractions import Fraction

import pytest
import xxhash
from pyspark.sql import functions as F

from arcweft.llm import chat, fingerprint, mixing, queries_native
from arcweft.llm.common import ranked

# --- chat ---

LOG = "conv_id long, seq long, msg long, kind string, role string, text string"


def fold(spark, events):
    out = chat.render(chat.messages(spark.createDataFrame(events, LOG)))
    rows = out.select("conv_id", chat.turns(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("learn"), "formatted").collect()
    return {r.conv_id: ([(t.role, t.text) for t in r.t], r.learn) for r in rows}


def test_deltas_edits_and_regenerations(spark):
    events = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", ""), (1, 2, 1, "delta", "assistant", "old "), (1, 3, 1, "delta", "assistant", "answer"),
        (1, 4, 2, "message", "user", "and?"), (1, 5, 1, "regenerate", "assistant", ""), (1, 7, 1, "delta", "assistant", "answer"), (1, 6, 1, "delta", "assistant", "new "),
        (1, 8, 0, "edit", "user", "hello"), (2, 0, 0, "delta", "user", "lone"), (3, 0, 5, "message", None, None), (3, 0, 5, "message", None, None), (None, 1, 1, "message", "assistant", "n"),
    ]
    random.Random(1).shuffle(events)
    got = fold(spark, events)
    assert got[1] == ([("user", "hello"), ("assistant", "new answer")], "new answer")
    assert got[2] == ([("user", "lone")], "") and got[3] == ([("", ""), ("", "")], "") and got[None] == ([("assistant", "n")], "n")


def plain_fold(events):
    """What a log leaves, by going through it event by event."""
    texts = {}
    for _, seq, msg, kind, role, text in sorted(events, key=lambda e: e[1]):
        if kind == "regenerate":
            for m in [m for m in texts if m > msg]:
                del texts[m]
        if kind == "delta" and msg in texts:
            texts[msg] = (texts[msg][0], texts[msg][1] + text)
        else:
            texts[msg] = (role, text)
    return [texts[m] for m in sorted(texts)]


def test_logs_of_many_blocks_fold_as_one_by_one(spark):
    r, events = random.Random(3), []
    for conv in range(12):
        seq = 0
        for _ in range(r.choice([3, 40, 400])):
            msg, kind = r.randrange(r.choice([4, 90, 300])), r.choice(["message", "delta", "delta", "edit", "regenerate"] if r.random() < 0.2 else ["message", "delta", "edit"])
            events.append((conv, seq, msg, kind, r.choice(["user", "assistant"]), f"t{seq} "))
            seq += 1
    shuffled = [(c, s, m, "edit" if k == "message" else k, role, text) for c, s, m, k, role, text in events]  # a second `message` would open a turn of its own
    r.shuffle(shuffled)
    got = fold(spark, shuffled)
    for conv in range(12):
        assert got.get(conv, ([],))[0] == plain_fold([e for e in shuffled if e[0] == conv]), conv


def test_log_of_a_table_uses_all_kinds(spark):
    table = spark.createDataFrame([(c, t, "user", f"text {t}") for c in range(8) for t in range(9)], "conv_id long, turn long, role string, text string")
    log = chat.events_of(table)
    assert {e.kind for e in log.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    back = chat.messages(log).select("conv_id", "msg", F.explode("turns").alias("t")).select("conv_id", "msg", "t.role", "t.text")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, table.collect()))


def test_control_strings_come_back(spark):
    r = random.Random(2)
    parts = ["<|turn|>", "<|text|>", "<|end|>", "<", "|", "\\", "<\\|", "<\\\\|end|>", "</s>[INST]", "\n", "é", "x", ""]
    text = lambda: "".join(r.choice(parts) for _ in range(r.randint(0, 8)))
    events = [(k, i, i, "message", r.choice(["assistant", "user", "<|end|>"]), text()) for k in range(60) for i in range(r.randint(1, 200 if k == 0 else 5))]
    got = fold(spark, events)
    for k in {e[0] for e in events}:
        own = [(e[4], e[5]) for e in events if e[0] == k]
        assert got[k] == (own, "".join(t for role, t in own if role == "assistant"))


def test_chat_on_nothing(spark):
    assert chat.render(chat.messages(spark.createDataFrame([], LOG))).count() == 0


def test_chat_query_against_sql(spark, tmp_path):
    import duckdb

    rows = [(1, 0, "user", "a <| b"), (1, 1, "assistant", None), (2, 3, None, "x"), (2, 3, None, "x"), (2, 1, "assistant", "<\\|"), (None, 0, "system", "s")]
    spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, seq string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(map(repr, map(tuple, queries_native.op6_chat_format(spark, str(tmp_path)).collect())))
    con = duckdb.connect()
    con.execute(f"create view conversations as select conv_id, turn, role, text from '{tmp_path}/conversations.parquet/*.parquet'")
    assert got == sorted(map(repr, con.execute(queries_native.OP6_SQL).fetchall()))


# --- mixing ---


def reshared(sizes, weights=(3, 1, 2)):
    """Targets by dealing the excess again until none is above its bound, in exact arithmetic."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, rest, free = dict.fromkeys(order, Fraction(0)), Fraction(3 * sum(sizes.values()), 2), set(order)
    while rest and free:
        total, share, rest = sum(weight[s] for s in free), rest, Fraction(0)
        for s in sorted(free, key=str):
            target[s] += share * weight[s] / total
        for s in list(free):
            if target[s] >= 2 * sizes[s]:
                rest += target[s] - 2 * sizes[s]
                target[s] = Fraction(2 * sizes[s])
                free.discard(s)
    return target


DOCS = "doc_id long, text string, source string, _k string, size string"


@pytest.mark.parametrize("seed", range(4))
def test_targets_and_copies(spark, seed):
    r = random.Random(seed)
    names = ["b", "a", "é", None, "zz", "", "Z"][: r.randint(1, 7)]
    docs = [(i if i % 9 else None, " ".join(["w"] * r.choice([0, 1, 2, 5, 40])) if r.random() < 0.9 else None, r.choices(names, [9, *[1] * (len(names) - 1)])[0], "k", "s") for i in range(300)]
    docs += docs[:20]
    sized = mixing.sizes(spark.createDataFrame(docs, DOCS))
    rows = mixing.copies(sized).collect()
    sizes = {}
    for _, text, source, *_ in docs:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    expected = reshared(sizes)
    assert len(rows) == len(docs)
    for s in sizes:
        own = [x for x in rows if x.source == s]
        assert {x.source_size for x in own} == {sizes[s]} and abs(own[0].target - expected[s]) < 1e-6
        assert all(0 <= x.copies <= 2 for x in own)
        assert abs(sum(x.copies * x["size"] for x in own) - expected[s]) <= max(x["size"] for x in own) + 1e-6
    key = lambda x: (str(x.doc_id), str(x.source), x["size"], x.copies)
    assert sorted(map(key, mixing.copies(sized).collect())) == sorted(map(key, rows))


def test_mix_repeats_whole_rows(spark):
    docs = [(i, "a b c", "x" if i % 3 else "y", f"k{i}", "s") for i in range(60)] + [(7, "a b c", "x", "k7", "s")] * 5
    df = spark.createDataFrame(docs, DOCS)
    out = mixing.mix(df)
    assert out.columns == df.columns
    total = sum(r.copies for r in mixing.copies(mixing.sizes(df)).collect())
    assert out.count() == total and set(map(tuple, out.collect())) <= set(docs)
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.copies(mixing.sizes(df.limit(0))).count() == 0


def test_rank_without_one_task(spark):
    rows = [(i % 7, "g" if i % 3 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "x int, g string")
    got = ranked(df, ["x"], group="g").collect()
    for g in ("g", None):
        own = sorted(r["rank"] for r in got if r.g == g)
        assert own == list(range(len(own)))
        assert [r.x for r in sorted((r for r in got if r.g == g), key=lambda r: r["rank"])] == sorted(r.x for r in got if r.g == g)


# --- fingerprints ---


def lanes(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.f for r in df.select("i", fingerprint.lanes(F.col("t")).alias("f")).orderBy("i").collect()]


def test_order_does_not_matter_but_multiplicity_does(spark):
    a, b, c, d, e, f = lanes(spark, ["x.\ny.\nz", "z\nx.\ny.", "x.\ny.\nz\nz", "x.\ny.", None, ""])
    assert a == b != c and a != d and e == f


def test_insertion_and_deletion(spark):
    r = random.Random(3)
    paragraphs = [" ".join(r.choice("abcdefg") for _ in range(5)) + "." for _ in range(40)]
    whole, first, second = lanes(spark, ["\n".join(paragraphs), "\n".join(paragraphs[:15]), "\n".join(paragraphs[15:])])
    one = spark.createDataFrame([(whole, first, second)], "w array<long>, a array<long>, b array<long>")
    got = one.select(fingerprint.combine(F.col("a"), F.col("b")).alias("sum"), fingerprint.combine(F.col("w"), F.col("b"), -1).alias("rest")).first()
    assert got["sum"] == whole and got["rest"] == first


def test_likeness_follows_shared_sentences(spark):
    r = random.Random(4)
    s = [" ".join(r.choice("abcdefghij") + str(i) for _ in range(6)) + "." for i in range(400)]
    pairs = [(" ".join(s[:200]), " ".join(s[:200])), (" ".join(s[:200]), " ".join(s[:100] + s[200:300])), (" ".join(s[:200]), " ".join(s[200:])), ("", ""), ("", "a."), (None, "")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").withColumns({"fa": fingerprint.lanes(F.col("a")), "fb": fingerprint.lanes(F.col("b"))})
    got = [x.n for x in df.select("i", fingerprint.likeness(F.col("fa"), F.col("fb")).alias("n")).orderBy("i").collect()]
    assert got[0] == 1 and 0.3 < got[1] < 0.7 and got[2] < 0.3 and got[3] == 1 and got[4] == 0 and got[5] == 1


def test_long_texts_do_not_overflow(spark):
    a, b = lanes(spark, ["a.\n" * 100_000, "a.\n" * 100_000])
    assert a == b


def test_likeness_of_texts_of_many_sentences(spark):
    text = lambda mark, n: "\n".join(f"{mark}{i} line." for i in range(n))
    n = 40_000
    whole = text("a", n)
    half = whole[: len(whole) // 2] + text("b", n // 2)
    pairs = [(whole, text("c", n)), (whole, half), (text("a", 100_000), text("c", 100_000)), ("x y.\n" * 20_000, "x y.\n" * 40_000), ("x y.\n" * 70_000, text("a", 300))]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").withColumns({"fa": fingerprint.lanes(F.col("a")), "fb": fingerprint.lanes(F.col("b"))})
    got = [x.n for x in df.select("i", fingerprint.likeness(F.col("fa"), F.col("fb")).alias("n")).orderBy("i").collect()]
    assert got[0] < 0.3 and 0.3 < got[1] < 0.85 and got[2] < 0.3 and abs(got[3] - 0.8) < 1e-3 and got[4] < 0.1


def test_sentence_lanes_across_runs(spark):
    lines = [f"{i} line." for i in range(70_000)]
    whole, first, second = lanes(spark, ["\n".join(lines), "\n".join(lines[:33_000]), "\n".join(lines[33_000:])])
    one = spark.createDataFrame([(whole, first, second)], "w array<long>, a array<long>, b array<long>")
    got = one.select(fingerprint.combine(F.col("a"), F.col("b")).alias("sum"), fingerprint.combine(F.col("w"), F.col("b"), -1).alias("rest")).first()
    assert got["sum"] == whole and got["rest"] == first and whole[-1] == 70_000


def plain_fingerprint(text):
    """Counts without bounds: sums of paragraph lanes, and of each bit of the sentences' hashes."""
    signed = lambda x, bits: x & ((1 << bits) - 1)
    spark_hash = lambda t, n: xxhash.xxh64_intdigest(n.to_bytes(4, "little"), xxhash.xxh64_intdigest(t.encode(), 42))
    wide = [[0, 0] for _ in range(4)]
    for p in text.split("\n"):
        for i in range(4):
            h = spark_hash(p, i)
            wide[i][0] += signed(h, 31)
            wide[i][1] += signed(h >> 32, 30)
    sentences = [s for s in re.split(r"(?<=[.!?])[ \t]+|\n", text) if s]
    bits = [[sum(h >> b & 1 for h in hashes) for b in range(64)] for hashes in ([spark_hash(s, 100 + k) for s in sentences] for k in range(2))]
    longs = [(lo % 2**31) | (hi % 2**30) << 32 for lo, hi in wide]
    longs += [bits[k][j] | bits[k][j + 32] << 32 for k in range(2) for j in range(16)] + [bits[k][j + 16] | bits[k][j + 48] << 32 for k in range(2) for j in range(16)]
    return "".join(f"{x:016x}" for x in [*longs, len(sentences)]), ([b for row in bits for b in row], len(sentences))


def plain_likeness(a, b):
    if a[0] == b[0]:
        return 1.0
    square = lambda bits, n: sum((2 * x - n) ** 2 for x in bits)
    (x, n), (y, m) = a[1], b[1]
    both = square(x, n) + square(y, m)
    return max(0.0, min(1.0, 1 - square([p - q for p, q in zip(x, y, strict=True)], n - m) / both)) if both else 0.0


def test_fingerprint_query_against_a_plain_version(spark, tmp_path):
    r = random.Random(4)
    sentence = lambda: " ".join(f"w{r.randrange(300)}" for _ in range(r.randint(1, 7))) + r.choice(". ! ? ,".split())
    texts = ["\n".join(" ".join(sentence() for _ in range(r.randint(0, 5))) for _ in range(r.randint(1, 6))) for _ in range(40)] + ["", None, "é", texts_end := "a. b.\n\nc", texts_end]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: x for x in queries_native.op9_fingerprint(spark, str(tmp_path)).collect()}
    whole = [t or "" for t in texts]
    for i, t in enumerate(whole):
        after = whole[(i + 1) % len(whole)]
        need = len(t) // 2
        edited = t[: len(t) - need] + after[:need]
        own, other, follows = plain_fingerprint(t), plain_fingerprint(edited), plain_fingerprint(after)
        assert got[i].fingerprint == own[0] and got[i].edited_fingerprint == other[0]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        assert got[i].near_edited == pytest.approx(plain_likeness(own, other)) and got[i].near_next == pytest.approx(plain_likeness(own, follows))


def edited_texts(rows):
    """Brute force over distinct (id, text), nulls last."""
    order = sorted({(i is None, i or 0, t or "") for i, t in rows}, key=lambda x: x[:2])
    out = {}
    for k, (null, i, t) in enumerate(order):
        head, n = order[(k + 1) % len(order)][2], len(t)
        out[None if null else i] = hashlib.sha256((t[: n - n // 2] + head[: n // 2]).encode()).hexdigest()
    return out


@pytest.mark.parametrize("rows", [[(5, "abcdef"), (2, "xyz"), (9, None), (7, "é" * 7), (None, "null id")], [(1, "only one")], [(1, "ab"), (1, "ab"), (3, "cdcd")], []])
def test_edited_text_takes_the_head_of_the_next(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, edited string, _k int").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries_native.op9_fingerprint(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    expected = edited_texts(rows) if rows else {}
    for r in got:
        assert r.edited_sha256 == expected[r.doc_id] and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
