"""A corpus pipeline over the documents table: filter, two kinds of deduplication, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on every row of ``docs`` and returns the columns of documents; the last
returns packed pieces. A stage's result is written as Parquet and read again before the next one starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitworks.llm import cuckoo, mixing, neardup, quality, queries
from gaitworks.llm.common import stored
from gaitworks.operators import ordering

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _told(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` with a digest of the text as ``exact_duplicates`` sees it: with doc_id it tells a row from its like."""
    return docs.select(*COLUMNS, F.sha2(cuckoo.normalised("text"), 256).alias("digest"))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on this input's labelled rows, predicts to be good.

    Null and empty texts are scored like any other; equal texts have equal scores; repeated rows stay or go together.
    """
    rows = queries.episodes(docs)
    model = quality.fit(rows, queries.good_labels(spark, sf_dir))
    whole = docs.select(F.col("doc_id").alias("episode_index"), F.col("text").alias("instruction"), "lang", "source", "n_chars")
    scored = quality.score_quality(whole, model, keep=("instruction", "lang", "source", "n_chars"))
    return scored.where("predicted = 1").select(F.col("episode_index").alias("doc_id"), F.col("instruction").alias("text"), "lang", "source", "n_chars")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of equal texts: the smallest doc_id, once.

    Null text is the empty text. A null doc_id stays only where all its equals have none. Of rows with one doc_id those
    with different texts are judged apart; repeated rows, and rows whose texts differ in white space only, leave one.
    """
    kept = cuckoo.exact_duplicates(queries.episodes(docs)).where("kept")
    kept = kept.select(F.col("episode_index").alias("id"), F.col("text_sha256").alias("sha")).distinct()
    rows = _told(docs).join(kept, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("sha")), "left_semi")
    return rows.dropDuplicates(["doc_id", "digest"]).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (Jaccard of 0.8 or more): the first by doc_id, then digest.

    Rows are numbered in that order, null doc_id last, so that rows which share a doc_id are judged apart. Documents
    without words stay.
    """
    order = [F.col("doc_id").asc_nulls_last(), "digest", "text", "source", "lang", "n_chars"]
    rows = ordering.global_index(_told(docs), order, "row_no")
    kept = neardup.near_duplicates(rows.select(F.col("row_no").alias("episode_index"), F.col("text").alias("instruction")), percent=80).where("kept")
    return rows.join(kept.select(F.col("episode_index").alias("row_no")), "row_no", "left_semi").select(*COLUMNS)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each 0, 1 or 2 times, so that the words of each source meet its target to half a document.

    Documents without words (null or empty text too) weigh nothing and stay once; null is a source of its own. Rows of
    one doc_id and source go together.
    """
    times = mixing.whole_episode_times(queries.episodes(docs)).select(F.col("source_dataset").alias("s"), F.col("episode_index").alias("id"), "times")
    drawn = docs.select(*COLUMNS).join(times, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("s")))
    return drawn.select(*COLUMNS, F.explode(F.sequence(F.lit(1), "times")).alias("time")).drop("time")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids along the curve, a row per piece. Null text is empty: its end id alone. Repeated rows are packed each."""
    return queries.packed(queries.episodes(docs))


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing to target weights", mix_to_targets),
    ("curve packing", pack),
]

#: A trained model, a tokenizer and hash draws stand between input and result, which SQL cannot state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
