"""Corpus pipeline: toxicity, quality, near-duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and reread as the next stage's ``docs``. All but the last return the
columns of ``documents``, extra ones too.

Null and empty texts have no marks and are not toxic; they have no words and go with the quality stage.
Rows without an id pass near_dedup and suffix_dedup as they are; rows that share an id stay or
go together in near_dedup and keep their own cuts in suffix_dedup. Ties go to the smallest id. Long texts are
worked on whole. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.llm import op01_quality, op03_suffix, op08_packing, op09_toxicity, op10_minhash
from seriesforge.llm.common import materialise


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5."""
    model = op09_toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return op09_toxicity.score(docs, model).where("toxic_predicted = 0").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.5."""
    return op01_quality.score(docs, op01_quality.train(docs)).where("quality_score >= 0.5").select(*docs.columns)


#: Similarity of the near_dedup stage in percent; its bands miss a pair of that similarity with probability 3e-5.
NEAR, NEAR_BANDS, NEAR_ROWS = 80, 34, 6


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of every near-duplicate group, linked at ``NEAR`` percent of five-word shingles.

    Documents without an id stay.
    """
    groups = op10_minhash.near_duplicates(docs, num=NEAR, bands=NEAR_BANDS, rows=NEAR_ROWS)
    kept = groups.where("kept").select("doc_id")
    named = docs.join(kept, "doc_id", "left_semi").select(*docs.columns)
    return named.unionByName(docs.where("doc_id is null"))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that occur earlier; ``n_chars`` follows the text."""
    return op03_suffix.remove_repeats(docs).withColumn("n_chars", F.char_length("text").cast("bigint")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their bins."""
    return op08_packing.pack(docs)


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("packing", packing)]

#: SQL states neither the classifiers nor the packing; tests compare run() with a brute-force pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
