"""The corpus pipeline: documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are written as Parquet
and read again. All but the last return the columns of documents, whatever they are: the stages need doc_id and text,
the first lang as well, and names of their own give way to those of the table. Each stage decides
by row: rows of a null or repeated doc_id are documents of their own. Whole texts count, however long. An empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from driftbasket.llm import decontaminate, ngram_join, packing, secrets
from driftbasket.llm import quality as rules
from driftbasket.llm.common import materialize, table
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; references of the languages come from good labelled documents. Null, empty and
    word-free texts go, as having under ten words; where the language is null or has no reference, only the plain rules
    decide; equal rows fare alike."""
    references = rules.fit_references(docs, table(spark, sf_dir, "labels"))
    return rules.keep(docs, references)


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key of each row, written once so that it stays the same; the key's name is new to docs."""
    key = "row"
    while key in docs.columns:
        key += "_"
    return materialize(docs.withColumn(key, F.monotonically_increasing_id()), "rows"), key


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked ones: that of the smallest id, a null one last, and of rows that repeat it
    any one. Rows that link with none stay, among them all null, empty and word-free texts."""
    rows, key = _keyed(docs)
    groups = ngram_join.join(rows.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias(key), "component_id")
    groups = materialize(groups, "groups")
    several = groups.where(F.col("component_id") != F.col(key)).select("component_id").distinct()
    named = rows.select(key, F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(key).alias("row")).alias("order"))
    linked = materialize(groups.join(several, "component_id", "left_semi").join(named, key), "linked")
    first = linked.groupBy("component_id").agg(F.min("order")["row"].alias(key))
    gone = linked.select(key).join(first, key, "left_anti")
    return rows.join(materialize(gone, "gone"), key, "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that leak no benchmark item; null and empty texts leak none."""
    rows, key = _keyed(docs)
    gone = decontaminate.leaks(rows.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(key)).distinct()
    return rows.join(materialize(gone, "gone"), key, "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by [secret]; n_chars, if there is such a column, follows the text. Null texts stay null
    and empty ones empty; equal rows fare alike."""
    return secrets.redacted(docs, secrets.fit_grammar(docs))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens; a null or empty text is its end alone, and a null
    doc_id stays null."""
    out = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, window=4096)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", sequences),
]

#: SQL can't express the join's components at this size, the grammars or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
