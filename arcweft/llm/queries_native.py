"""Queries of the native operators: op6, op7, op9, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweft.llm import chat, fingerprint, mixing
from arcweft.llm.common import table


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    log = chat.events_of(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))
    out = chat.render(chat.messages(log))
    out = out.withColumns({"_turns": chat.turns(F.col("formatted")), "_learnt": chat.loss_text(F.col("formatted"), F.col("loss"))})
    digest = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"), F.length("_learnt").cast("long").alias("loss_chars"), F.sha2("_learnt", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


OP6_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|turn|><|text|><|end|>') + length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.copies(mixing.sizes(table(spark, sf_dir, "documents")))
    return taken.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("copies") * F.col("size")).alias("taken"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size::DOUBLE * 2 AS bound FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(bound) OVER (ORDER BY bound / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
                / sum(weight) OVER (ORDER BY bound / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(bound, coalesce((max(CASE WHEN bound >= level * weight THEN level END) OVER ()) * weight, bound)) AS target FROM l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS each_,
             row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS LAST) - 1 AS k,
             ('0x' || substr(md5('mix:' || coalesce(d.source, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (least(floor(each_ * (k + 1) + u) - floor(each_ * k + u), 2))::BIGINT * size AS taken FROM r"""


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fingerprint.beside_next(table(spark, sf_dir, "documents"))
    out = fingerprint.fingerprints(fingerprint.fingerprints(pairs, "text", "_own"), "edited", "_edited")
    return out.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint.text_of(F.col("_own")).alias("fingerprint"), fingerprint.text_of(F.col("_edited")).alias("edited_fingerprint"),
        fingerprint.likeness(F.col("_own"), F.col("_edited")).alias("near_edited"), fingerprint.likeness(F.col("_own"), F.col("next_fingerprint")).alias("near_next"),
    )


QUERIES = {"op6_chat_format": op6_chat_format, "op7_mix_sources": op7_mix_sources, "op9_fingerprint": op9_fingerprint}
SQL = {"op6_chat_format": OP6_SQL, "op7_mix_sources": OP7_SQL}
