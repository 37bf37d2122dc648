"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept,
and is written as Parquet before the next one reads it.  Further columns of any
name pass through untouched.  A document with a null doc_id is never rejected,
never a near-duplicate and loses no passage, but is mixed like any other.  The
first two stages judge ids: rows that share an id go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapwise.llm import minhash_dedup, quality_filter, sentencepiece_codec, source_mixing, substring_dedup
from gapwise.llm.queries import VOCABULARY
from gapwise.llm.store import keep


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rejected = quality_filter.judge(docs, labels).where(~F.col("kept")).select(F.col("id").alias("doc_id")).distinct()
    return docs.join(rejected, "doc_id", "left_anti").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least id."""
    dropped = minhash_dedup.near_duplicates(docs).where(~F.col("kept")).select(F.col("id").alias("doc_id")).distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)


def boxed(docs: DataFrame) -> DataFrame:
    """Whole rows as one column ``doc``, so that no name of theirs meets a stage's own."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has; emptied ones go.

    Rows that share an id each keep the rest of their own text, and equal rows
    stay as often as they came.  ``n_chars``, where there is one, is counted anew
    for the texts that lost something.
    """
    cleaned = substring_dedup.remove_repeats(docs).where("n_removed > 0").select(
        "id", "before", F.col("text").alias("rest")).dropDuplicates(["id", "before"])
    joined = boxed(docs).join(
        cleaned, (F.col("doc.doc_id") == F.col("id")) & (F.xxhash64("doc.text") == F.col("before")), "left")
    full = joined.where("id is null or trim(rest) != ''")
    anew = {"text": F.coalesce("rest", "doc.text"),
            "n_chars": F.when(F.col("id").isNotNull(), F.length("rest").cast("long")).otherwise(
                F.col("doc.n_chars") if "n_chars" in docs.columns else F.lit(None))}
    return full.select(*(anew.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them, each shard shuffled.

    Where a target falls inside a document, it is taken when at least half of
    its words are due.  What is taken of a row follows from its id (null too),
    source and size, so rows that share an id are taken each by its own size.
    """
    copies = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    due = source_mixing.mix(docs).where("taken > 0").withColumn("copies", copies).where("copies > 0").select(
        "id", "source", "size", "copies", "shard", "place").dropDuplicates(["id", "source", "size"])
    rows = boxed(docs).withColumn("words", source_mixing.word_count(F.col("doc.text")))
    repeated = rows.join(due, F.col("doc.doc_id").eqNullSafe(F.col("id")) & F.col("doc.source").cast("string").eqNullSafe(
        F.col("source")) & (F.col("words") == F.col("size"))).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    placed = repeated.select("doc", "shard", F.md5(F.concat_ws("|", "place", "copy")).alias("place"))
    return placed.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place").select(
        *(F.col(f"doc.`{c}`").alias(c) for c in docs.columns))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to the very text."""
    vocabulary = sentencepiece_codec.load_vocabulary(VOCABULARY)
    return sentencepiece_codec.round_trip(docs, vocabulary).select(
        F.col("id").alias("doc_id"), "ids", "n_tokens", "exact")


STAGES = [
    ("quality_classifier", quality),
    ("minhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("source_mixing", mixture),
    ("sentencepiece", token_ids),
]

#: A fitted classifier and a tokenizer have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
