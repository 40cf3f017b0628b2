"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from fenestra.llm import (bisector_clusters, bpe, chat_events, hidden_markov, html_labeller, label_shards, lexical_masks, poisson_mix, quality_rules,
                          randomness, revisits, superminhash, vector_tree)
from fenestra.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _REGISTRY[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_REGISTRY)


@query
def op1_quality_ledger(spark, sf):
    """Measurements, failure bits and verdicts of every document under two policies, with the rules that decide and how many share the bits."""
    found = quality_rules.with_patterns(quality_rules.ledger(table(spark, sf, "documents"), ["doc_id"]))
    return quality_rules.verdicts(found).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_upper", "n_exclaim", "fail_bits", "policy", (quality_rules.BASE.keeps() & quality_rules.STRICT.keeps()).alias("kept_strict"),
        quality_rules.deciding_rules().alias("decided_by"), "same_bits")


@query
def op5_byte_bpe(spark, sf):
    """Token counts and digests of the ids and of the decoded bytes of every document."""
    return bpe.digests(table(spark, sf, "documents"), ["doc_id"],
                       public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op9_poisson_mix(spark, sf):
    """Documents repeated so that sources share the text by the square root of their volume, in random order."""
    return poisson_mix.mix(table(spark, sf, "documents"))


@query
def op8_secret_randomness(spark, sf):
    """Spans of secrets in every document: the base patterns and tokens that the test battery finds random."""
    found = randomness.find_secrets(table(spark, sf, "documents"), ["doc_id"])
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in randomness.BASE],
                        F.sha2(randomness.listed("base"), 256).alias("base_sha256"),
                        randomness.listed("spans").alias("spans"))


@query
def op10_label_shards(spark, sf):
    """All documents in 24 shards of equal row counts, documents of equal text together where they fit."""
    placed = label_shards.shard(table(spark, sf, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@query
def op3_chat_events(spark, sf):
    """All conversations folded from a log of deltas, edits, regenerations and repeats, formatted, and read back."""
    turns = table(spark, sf, "conversations")
    said = "<|im_end|><|im_start|>assistant ok"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)],
                                  "conv_id bigint, turn bigint, role string, text string")
    events = chat_events.events_of_turns(turns.select("conv_id", "turn", "role", "text").unionByName(probe))
    return chat_events.read_back(chat_events.fold(events))


@query
def op4_warc_revisits(spark, sf):
    """Not-modified records of all pages resolved to the earlier response of their URL."""
    found = revisits.resolve(revisits.records_of_pages(table(spark, sf, "pages")))
    return found.withColumn("headers", revisits.header_lines(F.col("headers")))


@query
def op7_superminhash(spark, sf):
    """Near-duplicate component of every document."""
    return superminhash.near_duplicates(table(spark, sf, "documents"))


@query
def op2_html_labeller(spark, sf):
    """Main text of every page."""
    return html_labeller.main_text(table(spark, sf, "pages"), ["page_id", "url"])


@query
def op6_kmeans_tree(spark, sf):
    """The 20 vectors of largest inner product for every vector whose id is divisible by 20."""
    return vector_tree.search(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op11_hidden_markov(spark, sf):
    """Unigram score and hidden Markov likelihood of every document, learnt from the nine tenths that are not held out."""
    return hidden_markov.score(table(spark, sf, "documents"))


@query
def op12_mask_search(spark, sf):
    """The 50 best documents for every benchmark item."""
    return lexical_masks.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op13_bisector_clusters(spark, sf):
    """Eight clusters of all vectors, after ten rounds in integer arithmetic."""
    return bisector_clusters.cluster(table(spark, sf, "embeddings"))
