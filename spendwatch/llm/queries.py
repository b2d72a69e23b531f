"""The registered query of each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bin_packing, decontaminate, filter_audit, host_rules, html_wrapper, lang_id,
               neighbour_graph, ngram_join, prefix_trie, quality_bayes, source_mix, token_counts, warc)
from .common import read

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


@register("op1_ngram_join")
def q_ngram_join(spark, sf):
    return ngram_join.jaccard_components(read(spark, sf, "documents")).select("doc_id", "n_shingles", "component_id")


@register("op2_sharding")
def q_sharding(spark, sf):
    out = bin_packing.shard_documents(read(spark, sf, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                      F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


@register("op3_language_id")
def q_language_id(spark, sf):
    docs = read(spark, sf, "documents")
    model = lang_id.learn(docs.where(~lang_id.held_out()))
    return lang_id.predict(docs, model).select("doc_id", lang_id.held_out().alias("held_out"), "lang_pred", "score")


@register("op4_token_counts")
def q_token_counts(spark, sf):
    out = token_counts.token_counts(read(spark, sf, "documents"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"), "budget_chars")


@register("op5_quality_classifier")
def q_quality_classifier(spark, sf):
    out = quality_bayes.score_documents(read(spark, sf, "documents"), read(spark, sf, "labels"))
    return out.select("doc_id", "evidence", "site_rate", "path_rate", "score", (F.col("score") >= 0.5).alias("kept"))


@register("op6_decontamination")
def q_decontamination(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text")
    out = decontaminate.decontaminate(docs, read(spark, sf, "benchmark"))
    return out.select(F.col("c0").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"))


@register("op7_html_extraction")
def q_html_extraction(spark, sf):
    return html_wrapper.extract_pages(read(spark, sf, "pages"))


@register("op8_quality_rules")
def q_quality_rules(spark, sf):
    return host_rules.quality_rules(read(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@register("op9_source_mix")
def q_source_mix(spark, sf):
    return source_mix.mix(read(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@register("op10_warc")
def q_warc(spark, sf):
    return warc.archive_round_trip(read(spark, sf, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op11_prefix_trie")
def q_prefix_trie(spark, sf):
    return prefix_trie.prefix_trie(read(spark, sf, "conversations"))


@register("op12_neighbour_graph")
def q_neighbour_graph(spark, sf):
    rows = read(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return neighbour_graph.nearest(rows, F.col("vec_id") % 50 == 0)


@register("op13_filter_audit")
def q_filter_audit(spark, sf):
    return filter_audit.audit_filters(read(spark, sf, "documents"), read(spark, sf, "labels")).select(
        "part", "filter_order", "step", *filter_audit.COUNTS, "shapley")
