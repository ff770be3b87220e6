"""Registered queries of this subpackage, each over its whole table, and their SQL twins."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from topictide.llm import (
    chat_format, exact_search, html_text, merkle, mixing, ngram_join, packing, quality_model, quality_rules, secret_scan, spelling, substring_dedup,
    vector_dedup,
)
from topictide.llm.oracles import ORACLES  # noqa: F401
from topictide.llm.store import reach, table


def op1_quality_rules(spark, sf_dir):
    judged = quality_rules.clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_lines", "n_failed_lines", "kept_chars",
    )


def op2_best_fit_packing(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def op3_secret_scans(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan_secrets(docs)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model")


def op4_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_model.judge(docs).select("doc_id", F.round("score", 6).alias("score"), "kept")


def op5_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"))


def op6_chat_formatting(spark, sf_dir):
    return chat_format.format_chats(table(spark, sf_dir, "conversations"))


def op7_mixing_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return mixing.repeat_documents(docs, exponent=0.5, seed="mix").select(
        "doc_id", "source", "lang", "n_chars", "text", "copy", "n_copies"
    )


def op8_html_extraction(spark, sf_dir):
    return html_text.extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op9_exact_search(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return exact_search.top_inner_products(vectors, F.col("vec_id") % 50 == 0, k=5)


def op10_suffix_array_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.drop_repeated_substrings(docs).drop("kept_bytes")


def op11_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_vector_near_dedup(spark, sf_dir):
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark, sf_dir):
    return merkle.manifest(table(spark, sf_dir, "documents"))


def _with_path(query):
    """The query, with this repository on the path of Python workers that this session starts."""

    @functools.wraps(query)
    def run(spark, sf_dir):
        reach(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    f.__name__: _with_path(f)
    for f in (
        op1_quality_rules, op2_best_fit_packing, op3_secret_scans, op4_quality_classifier,
        op5_ngram_jaccard_join, op6_chat_formatting, op7_mixing_sources, op8_html_extraction, op9_exact_search,
        op10_suffix_array_dedup, op11_spelling_variants, op12_vector_near_dedup, op13_merkle_manifest,
    )
}
