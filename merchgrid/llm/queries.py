"""Registered queries of the pipeline operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from merchgrid.llm import bpe, conversation_repair, decontaminate, exact_dedup, html_text, language_id, lm_score, ngram_join, pii, quality, secret_scan, tokenizer_align, warc
from merchgrid.llm.common import bare, remainder


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def op1_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = bare(_read(spark, sf, "documents"), "doc_id", "text")
    labels = bare(_read(spark, sf, "labels"), "doc_id", "quality").where(remainder("doc_id", 5) != 0)
    # the sample is taken among the labels first, so only its texts are joined
    chosen = labels.where("quality is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(quality.MAX_ROWS)
    model = quality.fit(docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("quality").cast("int").alias("label")))
    out = quality.score(docs.withColumn("held_out", remainder("doc_id", 5) == 0), model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.round_trip(_read(spark, sf, "documents"), _vocabulary())


def op3_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.archived(_read(spark, sf, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_html_text(spark: SparkSession, sf: str) -> DataFrame:
    out = html_text.with_text(bare(_read(spark, sf, "pages"), "page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op5_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    out = decontaminate.with_leaks(bare(_read(spark, sf, "documents"), "doc_id", "text"), _read(spark, sf, "benchmark")).drop("text")
    items = F.array_distinct(F.transform("leaks", lambda x: x["item_id"]))
    return out.select("doc_id", (F.size("leaks") > 0).alias("contaminated"), F.size(items).cast("long").alias("n_items"), items.alias("item_ids"), F.to_json("leaks").alias("spans"))


def op6_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_dedup(_read(spark, sf, "documents"))


def op7_lm_score(spark: SparkSession, sf: str) -> DataFrame:
    docs = bare(_read(spark, sf, "documents"), "doc_id", "text")
    held = remainder("doc_id", 7) == 2
    out = lm_score.score(docs, docs.where(~held).select("text"))
    return out.select("doc_id", (remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.jaccard_classes(_read(spark, sf, "documents")).select("doc_id", "class_id", "n_links", "set_id")


def _equals(value: str):
    return lambda x: x == value


def op9_pii(spark: SparkSession, sf: str) -> DataFrame:
    out = pii.with_spans(bare(_read(spark, sf, "documents"), "doc_id", "text")).drop("text")
    base = F.filter("pii", lambda s: s["kind"].isin(pii.BASE))
    counts = {k: F.size(F.filter(F.transform("pii", lambda s: s["kind"]), _equals(k))).cast("long") for k in pii.BASE}
    return out.select("doc_id", *[n.alias(f"n_{k}") for k, n in counts.items()], F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("pii")).alias("spans"))


def op10_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = _read(spark, sf, "documents")
    held = remainder("doc_id", 4) == 2
    model = language_id.fit(docs.where(~held).select("text", "lang"))
    out = language_id.identify(bare(docs, "doc_id", "text").withColumn("held_out", held), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op11_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damage(_read(spark, sf, "conversations")))


def op12_tokenizer_align(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    out = tokenizer_align.align(bare(_read(spark, sf, "documents"), "doc_id", "text"), _vocabulary(), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    out = secret_scan.with_spans(bare(_read(spark, sf, "documents"), "doc_id", "text")).drop("text")
    base = F.filter("secrets", lambda s: s["kind"].isin(secret_scan.BASE))
    counts = {k: F.size(F.filter(F.transform("secrets", lambda s: s["kind"]), _equals(k))).cast("long") for k in secret_scan.BASE}
    return out.select("doc_id", *[n.alias(f"n_{k}") for k, n in counts.items()], F.sha2(secret_scan.joined(base), 256).alias("base_sha256"), secret_scan.joined(F.col("secrets")).alias("spans"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_bpe": op2_bpe,
    "op3_warc": op3_warc,
    "op4_html_text": op4_html_text,
    "op5_decontaminate": op5_decontaminate,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_lm_score": op7_lm_score,
    "op8_ngram_join": op8_ngram_join,
    "op9_pii": op9_pii,
    "op10_language_id": op10_language_id,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_tokenizer_align": op12_tokenizer_align,
    "op13_secret_scan": op13_secret_scan,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op3_warc": warc.ORACLE, "op6_exact_dedup": exact_dedup.ORACLE, "op11_conversation_repair": conversation_repair.ORACLE}
