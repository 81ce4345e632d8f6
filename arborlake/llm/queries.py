"""Named queries of the text operators: each applies its operator to the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.llm import decontaminate, html_text, language_id, mixing, pitman_yor, topk, toxicity, warc
from arborlake.llm.language_id import held_out
from arborlake.llm.near_dedup import NearDup, near_duplicates
from arborlake.llm.token_counts import TokenCount, token_counts

Query = Callable[[SparkSession, str], DataFrame]


#: Where the box keeps a public tokenizer's vocabulary.
VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), TokenCount(VOCABULARY))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), NearDup(percent=85)).select("doc_id", "n_shingles", "component_id", "kept")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~held_out(3, 1)))
    out = language_id.identify(docs, model)
    return out.select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score", "similarity", "rejected")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels").where(~held_out(4, 2)))
    return toxicity.toxicity(docs, model).select("doc_id", held_out(4, 2).alias("held_out"), "score", "predicted")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = pitman_yor.fit(docs, 7, 2, pitman_yor.PitmanYor(seat_contexts=True))
    out = pitman_yor.score(docs, model)
    return out.select("doc_id", held_out(7, 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score", "event_score", "perplexity")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.resolve_revisits(warc.page_captures(_table(spark, sf_dir, "pages")), keep=("page_id",))
    h = F.col("headers")
    return out.select(
        "page_id", "record_id", "url_key", "warc_type", "validator", "resolved", "status", "refers_to",
        h["etag"].alias("etag"), h["date"].alias("date"), h["cache-control"].alias("cache_control"), h["content-type"].alias("content_type"),
    )


QUERIES: dict[str, Query] = {
    "op1_token_counts": op1_token_counts,
    "op2_exact_topk": op2_exact_topk,
    "op3_html_text": op3_html_text,
    "op4_mix_sources": op4_mix_sources,
    "op5_near_dedup": op5_near_dedup,
    "op6_language_id": op6_language_id,
    "op7_toxicity": op7_toxicity,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_decontamination": op9_decontamination,
    "op10_warc_revisits": op10_warc_revisits,
}
ORACLE_SQL: dict[str, str] = {"op2_exact_topk": topk.ORACLE, "op4_mix_sources": mixing.ORACLE, "op10_warc_revisits": warc.ORACLE}
