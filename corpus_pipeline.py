"""The corpus pipeline: five stages over documents, each written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigreview.llm import bpe, decontaminate, jaccard, line_dedup, toxicity
from sigreview.llm.common import join_checked, pin, scratch_path
from sigreview.llm.queries import MULTI_RANKS, digests
from sigreview.session import shuffles_deleted


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5, by a model learned from the labels that aren't held out.
    Null texts count as empty and stay; repeated rows go or stay together; no documents give none."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = toxicity.score_column(toxicity.fit(toxicity.training_rows(docs, labels)))
    return docs.where(score(F.col("text")) < 0.5)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; n_chars follows the text.  No document goes, repeated rows and null
    texts included; no documents give none."""
    kept = line_dedup.drop_repeated_lines(docs)
    chars = F.when(F.col("line_dedup.n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", chars).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: five words, similarity of 0.8 or more; the smallest id stays,
    one without an id only where no copy has one.  Of rows that repeat it the least stays.
    Documents without words stay."""
    key = ["_id", "_th"]
    found = pin(jaccard.row_components(docs, n=5, percent=80).where("n_shingles > 0").select(*key, "stays"))
    gone = pin(found.where("NOT stays").select(*key).distinct())
    again = pin(found.where("stays").groupBy(*key).count().where("count > 1").select(*key))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_id"),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("_th"))
    kept = join_checked(rows, gone, key, "left_anti")
    if not again.isEmpty():
        once = join_checked(kept, again, key, "left_semi").groupBy(*key).agg(F.min("row").alias("row"))
        kept = join_checked(kept, again, key, "left_anti").select("row").unionByName(once.select("row"))
    return kept.select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs.  Null and wordless texts stay; repeated rows go or
    stay together, rows without an id by their text; no documents give none."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = pin(found.where("n_hit > 0").select("_id", "_th").distinct())
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_id"),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("_th"))
    return join_checked(rows, hit, ["_id", "_th"], "left_anti").select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document the number of its token ids, and the digests that show a round trip.  Null texts are empty;
    repeated rows have a row each; no documents give none."""
    return digests(bpe.encode(docs, MULTI_RANKS, public_tokenizers.PATTERN, decoded=True))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: The learned toxicity scores and byte-level merges can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        kept = stage(spark, docs, sf_dir)
        with shuffles_deleted(spark):
            kept.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
