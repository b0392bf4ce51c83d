"""The queries of the training-data operators, one for each, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import resources

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.llm import bpe, hmm, host_rules, merkle, minhash, mixing, planes, quality, quantisation, secrets, substring, trie, url_filter
from clausewright.llm._shared import table

#: Rules of the op4 contract, host and path joined.
URL_RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
#: Domains that are blocked where no rule fits, one a line.
LISTED_HOSTS = resources.files("clausewright.llm").joinpath("listed_hosts.txt").read_text().split()

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: A document with a score from here on is predicted good.
LEAST_QUALITY = 0.3


def op1_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scorer = quality.fit(docs, table(spark, sf_dir, "labels"), ~quality.held_out())
    scored = quality.score(docs, scorer)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= LEAST_QUALITY).cast("int").alias("predicted"))


def op2_fm_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op3_product_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantisation.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES, LISTED_HOSTS).select("page_id", "host", "path", "rule", "verdict")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge(table(spark, sf_dir, "documents")).drop("source")


def op7_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), VOCABULARY).select("doc_id", *bpe.digest_columns())


def op8_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op9_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = hmm.score(docs, hmm.train(docs.where(~hmm.held_out())))
    return scored.select("doc_id", hmm.held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_secret_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents")).select("doc_id", *secrets.digest_columns())


def op11_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.read(planes.write(table(spark, sf_dir, "documents"), VOCABULARY, end=2))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.prove(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_compression_quality, op2_fm_substrings, op3_product_quantisation, op4_url_filter, op5_mixing, op6_host_rules, op7_transducer_bpe, op8_tensored_minhash, op9_hidden_markov, op10_secret_novelty, op11_token_planes, op12_prefix_trie, op13_merkle_manifest)
}
