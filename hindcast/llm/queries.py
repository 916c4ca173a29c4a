"""The registered queries of this subpackage: each operator with its production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.llm import (
    conversation_repair,
    curriculum,
    decontaminate,
    filter_audit,
    host_quality,
    jaccard_join,
    language_gru,
    pii,
    token_counts,
    toxicity,
    url_rules,
    warc_index,
    weight_tree,
)

# The rules of the URL query.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
LINKS = jaccard_join.Similarity(words=3, times=90, over=100)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_host_quality(spark, folder):
    rows = host_quality.judged(_table(spark, folder, "documents").select("doc_id", "source", "text"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rejected"
    )


def op2_weight_tree(spark, folder):
    return weight_tree.sharded(_table(spark, folder, "documents"), shards=16)


def op3_toxicity(spark, folder):
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, folder, "labels"))
    return toxicity.scored(docs, model).select("doc_id", "held_out", "score", "predicted")


def op4_warc_index(spark, folder):
    return warc_index.archived(_table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture_time", "capture_no"
    )


def op5_url_rules(spark, folder):
    return url_rules.judged(_table(spark, folder, "pages"), url_rules.rules_table(spark, URL_RULES))


def op6_decontaminate(spark, folder):
    return decontaminate.judged(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op7_jaccard_links(spark, folder):
    """The whole join: the class of every document and the number of documents it links to."""
    found = jaccard_join.joined(_table(spark, folder, "documents"), similarity=LINKS)
    return found.select(F.col("key").alias("doc_id"), "n_shingles", "component_id", "n_links")


def op7_jaccard_join(spark, folder):
    """The classes alone."""
    found = jaccard_join.joined(_table(spark, folder, "documents"), similarity=LINKS, links=False)
    return found.select(F.col("key").alias("doc_id"), "n_shingles", "component_id")


def op8_curriculum(spark, folder):
    docs = _table(spark, folder, "documents").select("doc_id", "source", "text")
    mix = curriculum.mixed(docs).withColumn("_first", F.try_element_at("draws", F.lit(1)))
    rows = mix.select(
        "doc_id", "size", "source_size", "target", "taken", F.floor("_first.position").alias("position"), "_key"
    )
    return rows.orderBy("position", "_key").drop("_key")


def op9_language_gru(spark, folder):
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language_gru.fit(docs)
    return language_gru.labelled(docs.select("doc_id", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op10_pii(spark, folder):
    return pii.report(_table(spark, folder, "documents"))


def op11_conversation_repair(spark, folder):
    return conversation_repair.repaired(_table(spark, folder, "conversations"))


def op12_filter_audit(spark, folder):
    return filter_audit.audited(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op13_token_counts(spark, folder, path: str | None = None):
    """``path``: the vocabulary file, by default the installed one of byte pairs."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.counted(_table(spark, folder, "documents"), path)


QUERIES = {
    f.__name__: f
    for f in (
        op1_host_quality, op2_weight_tree, op3_toxicity, op4_warc_index, op5_url_rules, op6_decontaminate,
        op7_jaccard_links, op7_jaccard_join, op8_curriculum, op9_language_gru, op10_pii,
        op11_conversation_repair, op12_filter_audit, op13_token_counts,
    )
}
