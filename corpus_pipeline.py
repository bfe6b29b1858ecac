"""The corpus pipeline: language ID, near-duplicate removal, benchmark decontamination, surrogates for personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. run() writes what a stage
returns as Parquet in the shared folder and reads it again, so a lost executor costs at most the current stage.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language_id, near_dedup, packing, pii
from tidemark.llm.common import discard, durable, new_path, scratch, table
from tidemark.llm.queries import SPLIT, VOCABULARY

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Of the labelled texts of a length, at most this share is rejected where they score below the noise.
LOST = 0.02


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the rows with a language; drop texts without letters and those no nearer to a language than noise.

    lang becomes the prediction. The limit is that of random vectors. Short texts of a language score low too: at
    lengths (by powers of two) where many labelled ones lie below the noise, their own low percentile is the limit.
    """
    model = language_id.train(docs)
    seen = durable(language_id.predict(docs, model, keep=COLUMNS[1:]), "languages").where("lang_pred != 'und'")
    seen = seen.withColumn("_size", F.floor(F.log2(F.length("text"))))
    low = seen.where(F.col("lang").isNotNull()).groupBy("_size").agg(F.percentile(F.round("score", 3), LOST).alias("_low"))
    limit = F.least(F.lit(language_id.noise(len(model))), F.col("_low"))  # a null is left out
    kept = seen.join(F.broadcast(low), "_size", "left").where(F.col("score") >= limit)  # one row for each power of two
    return kept.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of texts alike by 0.8 over five-word shingles: that with the smallest id, rows without an id last.

    Each row is judged by itself, under a number of its own: rows that share an id, or have none, are told apart.
    Rows without words are alike with nothing and stay.
    """
    rows = durable(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    judged = durable(near_dedup.near_duplicates(rows.select("_row", "text"), id_col="_row", shingle=5, percent=80), "judged")
    several = durable(judged.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id"), "several")
    group = judged.join(several, "component_id").select("_row", "component_id")
    group = durable(group.join(rows.select("_row", "doc_id"), "_row"), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row")
    first = durable(group.groupBy("component_id").agg(F.min(order)["_row"].alias("_first")), "first")
    copies = durable(group.join(first, "component_id").where("_row != _first").select("_row"), "copies")
    return rows.join(copies, "_row", "left_anti").select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS[1:])
    return found.where("n_hit = 0").select(*COLUMNS)


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put surrogates in place of personal data; n_chars follows the text."""
    found = pii.replace(docs, pii.demo_key(), keep=("lang", "source"))
    return found.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences in length buckets and batches: doc_id, part, start, length, bucket, bound, batch, slot, batch_rows."""
    return packing.pack(docs, packing.TokenCounter(VOCABULARY, SPLIT))


STAGES = [("language_id", language), ("near_dedup", near_duplicates), ("decontamination", decontaminated), ("pii", without_pii), ("packing", packed)]

#: Hypervectors, keyed surrogates and tokenization have no SQL; tests/llm/test_pipeline.py holds the stages and run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents. Each stage's result is written; what it wrote in between, and its input, are deleted then."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_path(spark, name)
        with scratch(spark):
            docs = durable(stage(spark, docs, sf_dir), name, path)
        if before:
            discard(spark, before)
        before = path
    return docs
