"""The corpus pipeline: documents in, token ids of the documents that are kept out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, near_copies, pii, quality
from tidemark.llm.common import columns, durable, fresh, quoted, table


def _aside(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """docs with its columns of these names renamed, and expressions that give all columns of docs back."""
    taken = [c for c in docs.columns if c.lower() in names]
    new = dict(zip(taken, fresh(docs, *(f"own_{c}" for c in taken)), strict=True))
    return docs.withColumnsRenamed(new), [F.col(quoted(new.get(c, c))).alias(c) for c in docs.columns]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    named, own = _aside(docs, quality.RESULTS)
    return quality.classified(named, table(spark, sf_dir, "labels")).where(~F.col("reject")).select(*own)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard similarity 0.8 or more) exactly one row stays.

    Operator 6's fingerprints and Golay keys link first, each link verified by that similarity; an exact join finds the rest.
    Groups are the components of such pairs of rows, whatever their doc_id; texts without a word are copies of each other.
    The row with the smallest doc_id stays, one without a doc_id only if no other has one; rows of one doc_id are told
    apart by a hash of all their columns.
    """
    docs, own = _aside(docs, (near_copies.ROW, near_copies.NODE, near_copies.SIZE, near_copies.CELL, near_copies.PRINT, "component"))
    known = near_copies.marked(docs)
    named = known.join(near_copies.near_components(known).withColumnRenamed("node", near_copies.NODE), near_copies.NODE, "left")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64(*columns(docs)).alias("hash"), F.col(near_copies.ROW).alias("row"))
    first = named.groupBy(F.coalesce("component", near_copies.NODE).alias("group")).agg(F.min(order).alias("first"))
    return known.join(first.select(F.col("first.row").alias(near_copies.ROW)), near_copies.ROW, "left_semi").select(*own)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated with benchmark passages go."""
    named, own = _aside(docs, ("contaminated",))
    return decontaminate.contamination(named, table(spark, sf_dir, "benchmark"), keep=True).where(~F.col("contaminated")).select(*own)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts gives way to its kind; n_chars follows."""
    return pii.masked(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, and digests of them and of what they decode to."""
    return bpe.bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=True).drop("decoded")


STAGES = [("quality", keep_quality), ("near_dedup", keep_one_of_each_group), ("decontaminate", drop_contaminated), ("pii", mask_personal_data), ("encode", encode)]

#: SQL can express neither the classifier nor the token ids; tests compare every stage and run() with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
