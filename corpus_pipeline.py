"""From raw documents to packed sequences, in five stages that are each written out.

A stage's function takes (spark, docs, sf_dir) and returns a DataFrame; run()
writes it as Parquet in the folder that all executors share and reads it again
as the next stage's docs. All stages but the last keep the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decision_list, line_winnow, order_minhash, packing, pii
from millrace.llm.common import BLANKS, SPACE, remove, shared_folder, table

#: What line deduplication leaves of a document needs so many words, as quality rules ask of any document.
LEAST_WORDS = 10


def _resized(docs: DataFrame) -> DataFrame:
    """n_chars follows the text where docs has that column."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; rules come from the labels beside the documents.

    Null, empty and wordless texts are rejected, as all of under ten words.
    Repeated rows are judged alike. An empty table gives an empty table. Columns
    of docs that are named like the statistics stay as they are.
    """
    judged = decision_list.judge(docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row")), table(spark, sf_dir, "labels"))
    return judged.filter("kept").select("_row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated lines go, and documents of which fewer than LEAST_WORDS words are left.

    A near copy whose other lines went is such a husk, or text of its own. Null
    texts and texts without a word go. Repeated rows, equal in id and text, are
    one document and stay as they are; null ids come last. An empty table gives
    an empty table; clashing column names stay.
    """
    found = line_winnow.deduplicate(docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row")))
    found = found.select(*(F.col("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns))
    return _resized(found.filter(F.size(F.split(F.trim("text", F.lit(BLANKS)), SPACE)) >= LEAST_WORDS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, that of the least id; of rows equal in id and text one.

    Null texts count as empty ones, null ids come last; an empty table gives an
    empty table; clashing column names stay.
    """
    return order_minhash.keep_first(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets, and n_chars follows.

    Null and empty texts and repeated rows stay; an empty table gives an empty
    table; clashing column names stay.
    """
    return _resized(pii.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids and where each lies; other columns than doc_id and text are left out.

    A null or empty text is its end id alone; repeated rows are packed each; an
    empty table gives an empty table.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("near dedup", near_duplicates), ("personal data", personal_data), ("packing", packed)]

#: SQL can't express the learned rules or the tokenizer; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; the last one's rows, which are also written.

    The folder with them is the caller's to delete; those of the stages before
    are deleted as soon as the next one is written.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        if number:  # the rows before have been read for the last time
            remove(spark, f"{folder}/{number - 1}")
    return docs
