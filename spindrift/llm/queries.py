"""Queries of the training-data operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontaminate, language_id, media, oracle, preference, sampling, secrets, simhash, substring_dedup, token_counts, unigram, url_filter
from .common import read


def op1_preference_format(spark, sf_dir):
    return preference.format_preferences(read(spark, sf_dir, "conversations"))


def op2_gumbel_topk(spark, sf_dir):
    samples = sampling.encode_samples(read(spark, sf_dir, "documents"), model=unigram.model_path(spark), verify=True)
    return samples.select("doc_id", "sample", F.size("ids").cast("bigint").alias("n_pieces"), "ids", F.round("log_prob", 6).alias("log_prob"), F.round("perturbed", 6).alias("perturbed"), F.round("log_inclusion", 6).alias("log_inclusion"), "exact")


def op3_decontaminate(spark, sf_dir):
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_secret_scan(spark, sf_dir):
    return secrets.secret_digest(read(spark, sf_dir, "documents"))


def op5_simhash_dedup(spark, sf_dir):
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op6_token_counts(spark, sf_dir):
    return token_counts.token_counts(read(spark, sf_dir, "documents"), model=unigram.model_path(spark))


def op7_substring_dedup(spark, sf_dir):
    return substring_dedup.dedup_digest(read(spark, sf_dir, "documents"))


def op8_language_id(spark, sf_dir):
    return language_id.identify(read(spark, sf_dir, "documents"))


def language_of_pages(spark, sf_dir):
    """The same operator with all its evidence: markup, address suffix and host."""
    pages = read(spark, sf_dir, "pages")
    return language_id.identify(pages, "page_id", "html", language_id.declared_in(F.col("html")), language_id.host_in(F.col("url")), language_id.suffix_in(F.col("url")))


def op9_url_filter(spark, sf_dir):
    return url_filter.url_verdicts(read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")


def op10_gif_columns(spark, sf_dir):
    return media.media_digest(read(spark, sf_dir, "documents"))


def secret_base_spans(spark, sf_dir):
    """What of the fourth operator's result SQL can state."""
    return op4_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def url_rules(spark, sf_dir):
    """What of the ninth operator's result SQL can state."""
    return op9_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule")


def media_payloads(spark, sf_dir):
    """What of the tenth operator's result SQL can state."""
    return op10_gif_columns(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def queries():
    return {f.__name__: f for f in (op1_preference_format, op2_gumbel_topk, op3_decontaminate, op4_secret_scan, op5_simhash_dedup, op6_token_counts, op7_substring_dedup, op8_language_id, op9_url_filter, op10_gif_columns, language_of_pages, secret_base_spans, url_rules, media_payloads)}


def oracle_sql():
    return {"op1_preference_format": oracle.PREFERENCE, "op3_decontaminate": oracle.DECONTAMINATE, "op7_substring_dedup": oracle.SUBSTRINGS, "secret_base_spans": oracle.SECRETS, "url_rules": oracle.URL_RULES, "media_payloads": oracle.PAYLOADS}
