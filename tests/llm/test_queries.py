"""The registered queries over small tables: against plain versions, a library or SQL, and with their folds."""

import hashlib
import math
import random
import struct
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from arcweft.llm import queries_pairs, queries_text, toxicity
from tests.llm.test_pairs import brute, corpus

SYLLABLES = {"aa": "ka to mi re sun bel".split(), "bb": "schi grü ver ung lich zen".split()}


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def saved(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(folder / f"{name}.parquet"))
    return str(folder)


def test_bpe_query_is_the_librarys(spark, tmp_path):
    texts = ["", None, "Hello  world", "a<|endoftext|>b", "é" * 3000, "x  y\n\n", "Hello  world", "퟿\u0000 ok", "long " * 5000]
    folder = saved(spark, tmp_path, "documents", [(i, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, both string")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in queries_text.op2_bpe(spark, folder).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest() and got[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_join_query_against_all_pairs_and_sql(spark, tmp_path):
    rows = corpus(8)
    folder = saved(spark, tmp_path, "documents", [(i, t, "x") for i, t in rows], "doc_id long, text string, node string")
    got = sorted(map(tuple, queries_pairs.op8_ngram_join(spark, folder).select("doc_id", "n_shingles", "component_id").collect()))
    sets, classes = brute(rows)
    assert got == sorted((i, len(sets[i][0]), classes[i]) for i, _ in rows)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(queries_pairs.OP8_SQL).fetchall())


@pytest.fixture(scope="module")
def toxic(spark, tmp_path_factory):
    """Documents, labels, and the same with the labels of the held-out fold turned round."""
    r, folder, other = random.Random(2), tmp_path_factory.mktemp("toxic"), tmp_path_factory.mktemp("turned")
    words = ["".join(r.choice("bcdfglmnr") + r.choice("aeiou") for _ in range(r.randint(1, 3))) for _ in range(200)]
    docs, labels = [], []
    for i in range(700):
        text, y = [r.choice(words) for _ in range(r.randint(5, 40))], int(r.random() < 0.25)
        for _ in range(2 * y):
            text.insert(r.randint(0, len(text)), r.choice(["Scoundrel", "wretchings", "vilent"]))
        docs.append((i, " ".join(text), "x", "y"))
        labels.append((i, y))
    docs += [(1000, None, "x", "y"), (1001, "", None, None), (None, "scoundrel", "x", "y"), (3, "a second text", "x", "y")]
    for f, ls in ((folder, labels), (other, [(i, y if fold(i, 5) else 1 - y) for i, y in labels])):
        saved(spark, f, "documents", docs, "doc_id long, text string, lang string, source string")
        saved(spark, f, "labels", [(i, 1, y) for i, y in ls] + [(None, 1, 1), (5, 1, None), (6, 0, 9)], "doc_id long, quality int, toxic int")
    return str(folder), str(other), docs, dict(labels)


def test_toxicity_query_learns_from_its_folds_alone(spark, toxic):
    folder, other, docs, labels = toxic
    rows = queries_text.op5_toxicity(spark, folder).collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (r.doc_id is not None and fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    key = lambda r: (str(r.doc_id), r.score)
    assert sorted(map(key, rows)) == sorted(map(key, queries_text.op5_toxicity(spark, other).collect()))
    held_out = [r for r in rows if r.held_out and r.doc_id in labels and r.doc_id != 3]
    assert len(held_out) > 100 and sum(r.predicted == labels[r.doc_id] for r in held_out) > 0.97 * len(held_out)


def test_scores_are_those_of_plain_forward_and_backward_sums(spark, toxic):
    folder, _, docs, labels = toxic
    model = toxicity.fit([(t, labels[i]) for i, t, *_ in docs if i in labels and i != 3])
    e = np.exp(model.moves)
    for text in [t for _, t, *_ in docs][:60] + ["one\ntwo Scoundrel vilent\n\nthree " * 5, "", None]:
        p = []
        for line in (text or "").split("\n"):
            x = np.array([[1.0, math.exp(model.speak(w))] for w in toxicity.TOKENS.findall(line)])
            if not len(x):
                continue
            forward, backward = [x[0]], [np.ones(2)]
            for own in x[1:]:
                forward.append((forward[-1] @ e) * own)
                forward[-1] /= forward[-1].sum()
            for own in x[:0:-1]:
                backward.insert(0, e @ (own * backward[0]))
                backward[0] /= backward[0].sum()
            both = np.array(forward) * np.array(backward)
            p += (both[:, 1] / both.sum(1)).tolist()
        want = model.score(sum(p), max(p, default=0.0))
        assert toxicity.Scorer(model).texts([text], True)[0][0] == pytest.approx(want, abs=1e-9)


def test_language_query_learns_from_its_folds_alone(spark, tmp_path_factory):
    r, folder, other = random.Random(3), tmp_path_factory.mktemp("lang"), tmp_path_factory.mktemp("turned")
    docs = [(i, " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(5, 30))), lang, "s") for i, lang in enumerate(["aa", "bb"] * 150)]
    odd = [(1000, None, "aa", "s"), (1001, "", "bb", None), (1002, "12 + 3", None, "s"), (None, "katomi", None, None)]
    turned = [(i, t, lang if fold(i, 3) != 1 else "aabb".replace(lang, ""), "q") for i, t, lang, _ in docs]
    schema = "doc_id long, text string, lang string, source string"
    rows = queries_text.op10_language_id(spark, saved(spark, folder, "documents", docs + odd, schema)).collect()
    assert len(rows) == len(docs) + len(odd)
    assert all(x.held_out == (x.doc_id is not None and fold(x.doc_id, 3) == 1) and 0 <= x.score <= 1 for x in rows)
    assert {x.lang_pred for x in rows if x.doc_id in (1000, 1001, 1002)} == {"und"} and {x.lang_pred for x in rows} == {"aa", "bb", "und"}
    lang = {i: x for i, _, x, _ in docs}
    held_out = [x for x in rows if x.held_out and x.doc_id in lang]
    assert len(held_out) > 60 and sum(x.lang_pred == lang[x.doc_id] for x in held_out) > 0.97 * len(held_out)
    key = lambda x: (str(x.doc_id), x.lang_pred, round(x.score, 12))
    assert sorted(map(key, rows)) == sorted(map(key, queries_text.op10_language_id(spark, saved(spark, other, "documents", turned + odd, schema)).collect()))
