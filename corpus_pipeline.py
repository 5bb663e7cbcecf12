"""Corpus pipeline: quality rules, near-dedup, sanitisation, mixing, tokenisation.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents. Documents without a text fail the quality rules.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, minhash, mixing, pii, quality
from quire.llm.common import DOCUMENT_COLUMNS, bitmap, by_bitmap, narrowed, small_batches, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep.

    Null and empty texts have no words and go; repeated rows and rows without id are judged each by its text; very long
    texts go whole through one suffix array. Other columns are left out; no rows give no rows.
    """
    small_batches(spark)
    return quality.keep_good(docs.select(*DOCUMENT_COLUMNS))


def _told_apart(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """docs with `key`: the id, or of rows that share one a digest of id and text. Rows equal in both are one; the least stays.

    Also the rows whose key may not be their id, or None.
    """
    repeated = written(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("shared")))
    if repeated.isEmpty():
        return docs.withColumn("key", F.col("doc_id")), None
    wanted = bitmap(repeated, "doc_id")
    clear = docs.mapInArrow(partial(by_bitmap, column="doc_id", data=wanted, through=False), docs.schema)
    met = narrowed(docs, "doc_id", wanted).join(repeated, "doc_id", "left")
    digest = F.shiftrightunsigned(F.xxhash64("doc_id", F.coalesce("text", F.lit("")), F.col("text").isNull()), 2) + F.lit(1 << 62)  # behind usual ids
    met = met.withColumn("key", F.when(F.col("shared"), digest).otherwise(F.col("doc_id")))
    one = written(met.groupBy("key").agg(F.min(F.struct(*DOCUMENT_COLUMNS)).alias("x")).select("x.*", "key"))
    return clear.withColumn("key", F.col("doc_id")).unionByName(one), one


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id.

    Null and empty texts, texts without words and rows without id link with nothing and stay. Rows that share an id are
    documents of their own, but for those with the same text, of which the least stays. Other columns are left out; no
    rows give no rows.
    """
    small_batches(spark)
    keyed, shared = _told_apart(docs.select(*DOCUMENT_COLUMNS))
    groups = minhash.near_duplicates(keyed.select(F.col("key").alias("doc_id"), "text")).withColumnRenamed("doc_id", "key")
    if shared is not None:  # the smallest id of a group, not the smallest key
        ids = groups.where("key IS NOT NULL").join(shared.select("key", "doc_id"), "key", "left").select("key", "component_id", F.coalesce("doc_id", "key").alias("id"))
        heads = ids.groupBy("component_id").agg(F.min(F.struct("id", "key")).alias("x")).select("component_id", F.col("x.key").alias("head"))
        groups = ids.join(heads, "component_id").withColumn("kept", F.col("key") == F.col("head"))
    gone = written(groups.where("NOT kept").select("key"))
    # Only rows that a bit map of the ids in question lets through are shuffled for the exact join; the others stay where they are.
    wanted = bitmap(gone, "key")
    clear = keyed.mapInArrow(partial(by_bitmap, column="key", data=wanted, through=False), keyed.schema)
    left = narrowed(keyed, "key", wanted).join(gone, "key", "left_anti")
    return clear.select(*DOCUMENT_COLUMNS).unionByName(left.select(*DOCUMENT_COLUMNS))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data and what discloses it masked.

    Null and empty texts stay as they are; repeated rows and rows without id each get a row, equal texts the same one; very long
    texts are masked whole. Other columns are left out; no rows give no rows.
    """
    small_batches(spark)
    return pii.sanitise_documents(docs.select(*DOCUMENT_COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in as many copies as their source's target asks for.

    Texts without words have size 0 and as many copies as their source's others; a null source is a source, last in order;
    rows that share an id draw alike, rows without id by their text. Other columns are left out; no rows give no rows.
    """
    small_batches(spark)
    return mixing.mix_sources(docs.select(*DOCUMENT_COLUMNS))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every copy.

    A null or empty text has 0 tokens; repeated rows and rows without id each get a row; very long texts go through in
    pieces. Other columns are left out; no rows give no rows.
    """
    small_batches(spark)
    import public_tokenizers

    return bpe.tokenize(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality_rules), ("near dedup", near_dedup), ("sanitise", sanitise), ("mix", mix), ("tokenise", tokenise)]

#: The disclosure statistics and the BPE merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
