import gc
import hashlib
import random
import re
import struct
import time
from pathlib import Path

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from arcweft.llm import ngram_join, queries
from arcweft.llm.common import tidy

WORDS = {"aa": "ka to mi re sun bel".split(), "bb": "schi grü ver ung lich zen".split()}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean documents of two languages, exact and near copies, toxic and foreign ones, and labels."""
    r = random.Random(11)
    folder = tmp_path_factory.mktemp("corpus")
    text = lambda lang, n: " ".join("".join(r.choice(WORDS[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))
    rows, toxic, foreign, copies = [], set(), set(), {}
    for i in range(240):
        lang = r.choice(list(WORDS))
        t = text(lang, r.randint(40, 80))
        if i >= 60 and i % 6 == 0:
            words = t.split()
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(["villainous", "scoundrel", "wretched"]))
            t, _ = " ".join(words), toxic.add(i)
        elif i % 40 == 7:
            t, _ = " ".join("xqzjw"[r.randrange(5)] * 3 + "qkzx" for _ in range(50)), foreign.add(i)
        elif i % 10 == 3 and i > 20 and i - 2 not in toxic | foreign | set(copies):
            words = rows[i - 2][1].split()
            words[-1] = "kato"
            t, copies[i] = " ".join(words), i - 2
        rows.append((i, t, lang if i not in foreign else None, f"s{r.choice([0, 0, 0, 1, 2])}", len(t)))
    rows += [(500, None, None, None, 0), (501, "", None, "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(0, 240) if i % 4], "doc_id long, quality int, toxic int").union(spark.createDataFrame([(i, 1, 1) for i in sorted(toxic) if not i % 4], "doc_id long, quality int, toxic int")).write.parquet(str(folder / "labels.parquet"))
    return str(folder), rows, toxic, foreign, copies


def test_stages_do_what_they_say(spark, corpus, tmp_path):
    folder, rows, toxic, foreign, copies = corpus
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "near_duplicates", "mix", "bpe"]
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
        assert docs.columns == columns or name == "bpe"
    ids = {n: [r.doc_id for r in found] for n, found in kept.items()}
    everyone = {r[0] for r in rows}
    assert set(ids["language_id"]) == everyone - foreign - {500, 501}
    assert set(ids["toxicity"]) == set(ids["language_id"]) - toxic
    left = set(ids["toxicity"])
    text = {r[0]: r[1] for r in rows}
    sets = {i: set(ngram_join.shingles(text[i]).tolist()) for i in left}
    gone = {j for j in left if any(i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for i in left)}
    assert set(ids["near_duplicates"]) == left - gone and gone >= {c for c, o in copies.items() if o in left}
    assert set(ids["mix"]) <= set(ids["near_duplicates"]) and max(map(ids["mix"].count, set(ids["mix"]))) <= 2
    assert {(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in kept["mix"]} <= set(rows)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sorted(ids["bpe"]) == sorted(ids["mix"])
    for r in kept["bpe"]:
        found = library.encode(text[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(found) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(found)}I", *found)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_run_returns_what_the_stages_return(spark, corpus):
    folder, *_ = corpus
    first = sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()))
    assert first and first == sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()))


def test_columns_named_as_what_stages_add(spark, corpus):
    folder, *_ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "doc_id AS Language", "source AS toxicity", "text AS _language")
    for _, stage in corpus_pipeline.STAGES[:2]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.schema == docs.schema
        assert all(r.Language == r.doc_id and r.toxicity == r.source and r._language == r.text for r in out.collect())


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.SQL) <= set(queries.QUERIES)


def test_tidy_returns_memory_outside_the_heap(spark):
    jvm = spark.sparkContext._jvm
    status = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup")
    mb = lambda: int(re.search(r"Pss_Anon:\s+(\d+)", status.read_text())[1]) / 1024
    buffers = [jvm.java.nio.ByteBuffer.allocateDirect(64 << 10) for _ in range(3000)]
    buffers = buffers[::20]  # what stays lies between what goes, so that nothing goes by itself
    for _ in range(3):
        gc.collect()
        jvm.System.gc()
        time.sleep(0.5)
    freed = mb()
    tidy(spark)
    assert mb() < freed - 80 and buffers


def test_classes_take_no_large_plan(spark, corpus, monkeypatch):
    folder, *_ = corpus
    joins, cut = [], ngram_join.cut
    monkeypatch.setattr(ngram_join, "cut", lambda df: joins.append(len(re.findall(r"\bJoin ", df._jdf.queryExecution().optimizedPlan().toString()))) or cut(df))
    ngram_join.classes(spark.read.parquet(f"{folder}/documents.parquet"))
    assert len(joins) > 3 and max(joins) <= 9
