"""A corpus made ready for training: five stages, each over all that the one before it kept.

Low quality goes, near copies are reduced to one, secrets are masked, sources are mixed to
their target weights, and the texts are packed into sequences of tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topictide.llm import mixing, ngram_join, packing, quality_model, secret_scan
from topictide.llm.store import reach, saved

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near copies share this part of their runs of so many words. op5 has a rule of its own.
ALIKE_WORDS, ALIKE = 5, (80, 100)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    return quality_model.judge(docs).where("kept").select(*COLUMNS)


def keep_one_of_alike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of similar texts; one row of it."""
    linked = ngram_join.similar_documents(docs, n=ALIKE_WORDS, similarity=ALIKE)
    chosen = linked.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id")).distinct()
    kept = docs.join(chosen, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"]).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with [SECRET] in place of every finding; no document is lost."""
    scanned = secret_scan.scan_secrets(docs, redact=True)
    text = F.when(F.col("text").isNotNull(), F.col("redacted"))
    length = F.when(F.col("redacted") == F.col("text"), F.col("n_chars")).otherwise(F.length("redacted").cast("long"))
    return scanned.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("text").isNotNull(), length).otherwise(F.col("n_chars")).alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that a source weighs the square root of its size."""
    return mixing.repeat_documents(docs, exponent=0.5, seed="mix").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and offset."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_alike),
    ("secret scans", mask_secrets),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack),
]

#: No SQL: the classifier, the scanner and the tokenizer are not SQL. tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one gives is stored and read again for the next."""
    reach(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = saved(docs)
    return docs
