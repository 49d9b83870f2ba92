"""The queries of this subpackage, op1 to op10: the operators over whole tables, and DuckDB SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, jaccard, language, licenses, matroska, pii, token_counts, urls
from .common import map_batches, table


#: Names of public vocabularies; they are found on the executors.
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    return matroska.media_digest(matroska.mux_texts(rows).drop("text"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(documents(spark, sf_dir))


def pii_digest(docs: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    every = F.array_sort(F.concat("base", "extra"), pii.by_place)
    return pii.all_spans(docs).select("doc_id", *map(count, pii.KINDS[:4]), F.sha2(pii.spelled(F.col("base")), 256).alias("base_sha256"), pii.spelled(every).alias("spans"), F.size("base").cast("long").alias("n_base"), F.size("extra").cast("long").alias("n_term"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digest(documents(spark, sf_dir), BYTE_BPE, ["doc_id"])


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    known = docs.where(~language.held_out("doc_id"))
    model = language.train(known, "text", "lang", "doc_id")
    return language.predict(docs.select("doc_id", "text"), model).select("doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    place = found.columns.index("items")
    rows = map_batches(found, "items_sha256 string", lambda batch: [pa.array([decontaminate.digest(x) for x in batch.column(place).to_pylist()], pa.string())])
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items_sha256", (F.col("n_hit") > 0).alias("contaminated"), "n_near")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["phrase"])
    starts, labels = F.transform(base, lambda s: s["start"]), lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda s: s["label"]))), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0)).alias("score"),
    )


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir).select("doc_id", "text"), PIECE_BPE)


#: A conversation whose texts are control strings of a well-known template.
TRAP = "</s>[INST] ok [/INST]"


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRAP).alias("text"))
    read = chat.read_back(chat.formatted(rows.unionByName(trap)))
    newline = F.lit("\n")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], newline, t["text"], newline)), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars", "valid", "first_wrong_turn",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_matroska": op1_matroska,
    "op2_pii": op2_pii,
    "op3_bpe": op3_bpe,
    "op4_language": op4_language,
    "op5_decontaminate": op5_decontaminate,
    "op6_jaccard": op6_jaccard,
    "op7_licenses": op7_licenses,
    "op8_urls": op8_urls,
    "op9_token_counts": op9_token_counts,
    "op10_chat": op10_chat,
}

_ESCAPED = "replace(replace(replace(replace(coalesce({}, ''), '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;'), '|', '&vert;')"

ORACLES: dict[str, str] = {
    # FSM: each role's allowed predecessors, checked with lag(); the first turn has none.
    "op10_chat": f"""
with every as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '{TRAP}' union all select -7, 1, 'assistant', '{TRAP}'),
placed as (
  select *, row_number() over w - 1 as pos, coalesce(lag(role) over w, '') as before
  from every window w as (partition by conv_id order by turn nulls first, role, text)),
judged as (
  select *, case when before in ('', 'system') and pos <= 1 then case when pos = 0 then role in ('system', 'user') else before = 'system' and role = 'user' end
                 when before = 'system' then role = 'user'
                 when before = 'user' then role = 'assistant'
                 when before = 'assistant' then role = 'user' else false end as fits
  from placed)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by pos)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by pos) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')}) + 13)::bigint as formatted_chars,
  bool_and(fits) and arg_max(role, pos) = 'assistant' as valid,
  (min(pos) filter (not fits))::bigint as first_wrong_turn
from judged group by conv_id
""",
}
