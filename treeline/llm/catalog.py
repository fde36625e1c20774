"""Registered queries of this subpackage: one per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm import (align, decontaminate, fingerprint, jaccard, licenses, linededup, lm, mixing,
                          quality, tokenfile, toxicity, trie, urlfilter)
from treeline.llm.common import scratch, table, tokenizer_json


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint.digests(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark items contained in all documents."""
    return decontaminate.matches(table(spark, sf_dir, "documents"),
                                 table(spark, sf_dir, "benchmark"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every draw of a document: epoch, block, place of the block, order within it."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.selectExpr("doc_id", "source", "mix_tokens AS n_tokens", "mix_epoch AS epoch",
                            "mix_block AS block", "mix_block_rank AS block_rank",
                            "mix_order AS doc_order")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and removed lines of every document, md5 of the text that is left."""
    kept = linededup.dedupe(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", F.col("dedup_lines").alias("n_lines"),
                       F.size("dedup_removed").cast("long").alias("n_removed"),
                       F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in every document."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grade, expected severity and toxicity of every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, toxicity.severity_grades(docs, labels))
    scored = toxicity.score(docs, model)
    return scored.withColumn("toxic", (scored.p_toxic >= toxicity.REJECT).cast("int"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written as token ids, read back from the files."""
    path = scratch(spark, "token-files")
    tokenfile.write(table(spark, sf_dir, "documents"), path, tokenizer_json())
    return tokenfile.digests(spark, path)


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff score of every document under the counts of all documents."""
    scored = lm.score(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("score", 4).alias("score"),
                         F.round("mean", 6).alias("mean"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page; the list: the corpus's hosts with a listed word."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, _ = urlfilter.parts(F.col("url"))
    hosts = pages.select(host.alias("host")).filter(urlfilter.listed_by_word(F.col("host")))
    return urlfilter.judge(pages, hosts)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of similar documents of every document."""
    return jaccard.join(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, links and link counts of two tokenizers over every document."""
    return align.align(table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    return trie.trie(*trie.rebuilt(table(spark, sf_dir, "conversations")))


def op13_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by the votes of its nearest labelled ones."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_decontaminate": op2_decontaminate,
    "op3_mixing": op3_mixing,
    "op4_line_dedup": op4_line_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_toxicity": op6_toxicity,
    "op7_token_files": op7_token_files,
    "op8_lm_scores": op8_lm_scores,
    "op9_url_filters": op9_url_filters,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_token_alignment": op11_token_alignment,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_quality_votes": op13_quality_votes,
}
