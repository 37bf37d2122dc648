"""The registered queries of the operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapwise.llm import (
    ann_search, embedding_dedup, html_extract, language_id, minhash_dedup, quality_filter, run_detection,
    sentencepiece_codec, source_mixing, substring_dedup, token_alignment, toxicity, url_filter,
)
from gapwise.llm.sql import MIX_SQL, NEAR_DUPLICATES_SQL, NEAR_VECTORS_SQL, NEAREST_SQL, URL_SQL

#: Where the vocabulary lies; any SentencePiece model file may be named instead.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: The byte-level tokenizer that ``op12_token_groups`` aligns it with.
BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    mixed = source_mixing.mix(_table(spark, folder, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "shard")


def nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return ann_search.nearest(_table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every text, and whether they decode to the very text."""
    vocabulary = sentencepiece_codec.load_vocabulary(VOCABULARY)
    return sentencepiece_codec.round_trip(_table(spark, folder, "documents"), vocabulary).select(
        F.col("id").alias("doc_id"), "ids", "n_tokens", "exact")


def filter_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Pages are labelled by the quality of the document with their number."""
    outcomes = _table(spark, folder, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return url_filter.filter_urls(_table(spark, folder, "pages"), outcomes).select(
        F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def judge_quality(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_filter.judge(_table(spark, folder, "documents"), _table(spark, folder, "labels"))
    return judged.withColumnRenamed("id", "doc_id")


def near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_vectors(_table(spark, folder, "embeddings")).withColumnRenamed("id", "vec_id")


def extract_html(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.extract(_table(spark, folder, "pages")).withColumnRenamed("id", "page_id")


def score_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    scored = toxicity.score(_table(spark, folder, "documents"), _table(spark, folder, "labels"), ~held_out)
    return scored.withColumnRenamed("id", "doc_id").select("doc_id", held_out.alias("held_out"), "score", "predicted")


def remove_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def near_documents(spark: SparkSession, folder: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, folder, "documents"), words=2).withColumnRenamed("id", "doc_id")


def predict_language(spark: SparkSession, folder: str) -> DataFrame:
    def held_out(name):
        return F.crc32(F.col(name).cast("string")) % 4 == 2
    judged = language_id.identify(_table(spark, folder, "documents"), ~held_out("id"), keep_cols={"held_out": held_out("id")})
    return judged.withColumnRenamed("id", "doc_id")


def token_groups(spark: SparkSession, folder: str) -> DataFrame:
    return token_alignment.align(_table(spark, folder, "documents"), BYTE_LEVEL, VOCABULARY).withColumnRenamed("id", "doc_id")


def periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of words; every text whose crc32(doc_id) ends in 0 first repeats its end periodically."""
    docs = _table(spark, folder, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    words = F.filter(F.split("text", r"[ \t-\r]+"), lambda word: word != "")
    placed = docs.select("doc_id", "text", "h", F.when(F.col("h") % 10 == 0, words).alias("words")).select(
        "*", F.greatest(F.size("words"), F.lit(1)).alias("n"), F.floor(F.col("h") / 10).alias("g")).select(
        "*", F.expr("cast(g % n as int)").alias("a")).select(
        "*", F.expr("cast(1 + floor((n - a) / (3 + g % 8)) as int)").alias("p"))
    rewritten = F.expr("concat(slice(words, 1, a), slice(flatten(array_repeat("
                       "slice(words, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a))")
    made = placed.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.size("words") > 0), F.array_join(rewritten, " "))
                         .otherwise(F.col("text")).alias("text"))
    runs = run_detection.find_runs(made)
    first = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    longest = runs.select("id", "runs", "collapsed", first.alias("first"))
    return longest.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"),
        (-F.col("first.start")).alias("start"), F.col("first.length").alias("length"), (-F.col("first.period")).alias("period"),
        F.expr("1000 * first.length div -first.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": mix_sources,
    "op2_nearest_vectors": nearest_vectors,
    "op3_sentencepiece": sentencepiece,
    "op4_url_filter": filter_urls,
    "op5_quality": judge_quality,
    "op6_near_vectors": near_vectors,
    "op7_main_text": extract_html,
    "op8_toxicity": score_toxicity,
    "op9_substring_dedup": remove_repeats,
    "op10_near_documents": near_documents,
    "op11_language": predict_language,
    "op12_token_groups": token_groups,
    "op13_periodic_runs": periodic_runs,
}
ORACLE: dict[str, str] = {
    "op1_mix_sources": MIX_SQL,
    "op2_nearest_vectors": NEAREST_SQL,
    "op4_url_filter": URL_SQL,
    "op6_near_vectors": NEAR_VECTORS_SQL,
    "op10_near_documents": NEAR_DUPLICATES_SQL,
}
