"""The registered queries, one for each operator, and their DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe_tree, decision_list, fingerprint, html_blocks, line_winnow, order_minhash, packing, pii, sentence_spans, suffix_tree
from millrace.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    text = html_blocks.extract(table(spark, sf_dir, "pages"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of each document's ids lies."""
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op3_line_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its later repeated lines."""
    return line_winnow.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLES["op3_line_winnow"] = line_winnow.ORACLE


@query
def op4_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    judged = decision_list.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its later repeated passages."""
    return sentence_spans.remove_repeats(table(spark, sf_dir, "documents"))


@query
def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's log probability, by single words and by the suffix tree."""
    return suffix_tree.score(table(spark, sf_dir, "documents"))


@query
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts, and a digest and list of spans."""
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*pii.BASE_KINDS))
    return pii.find(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *(pii.count(spans, kind).alias(f"n_{kind}") for kind in pii.BASE_KINDS),
        F.sha2(pii.listing(base), 256).alias("base_sha256"),
        pii.listing(spans).alias("spans"),
    )


@query
def op8_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every document, as digests."""
    vocab = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = bpe_tree.encode(table(spark, sf_dir, "documents"), vocab, public_tokenizers.PATTERN, decoded=True)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they and the next document's are."""
    found = fingerprint.compare_with_next(table(spark, sf_dir, "documents"))
    own, edited, after = F.col("fingerprint"), F.col("edited_fingerprint"), F.col("next_fingerprint")
    return found.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint.listing(own).alias("fingerprint"),
        fingerprint.listing(edited).alias("edited_fingerprint"),
        fingerprint.likeness(own, edited).alias("near_edited"),
        fingerprint.likeness(own, after).alias("near_next"),
    )


@query
def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near duplicates that each document is in."""
    return order_minhash.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")
