"""From raw documents to a training mix: quality, lines, near duplicates, benchmark passages, source weights.

Each stage takes the documents that the one before it kept, and all but the last return
the columns of ``documents``. Every decision takes effect on the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontamination, line_dedup, minhash_dedup, mixing, quality
from tidewatch.llm.common import stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    scored = quality.with_quality(docs, model)
    return scored.where(F.col("__quality.score") >= quality.THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated cross-site boilerplate; a document of nothing else goes. n_chars follows the text."""
    out = line_dedup.line_dedup(docs, keep_columns=True, drop_emptied=True)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, similarity 0.8.

    Rows are numbered, so rows without an id, of one id or equal ones are told apart; of a group the row with the
    least number stays. A document without words is in no group.
    """
    rows = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    near = minhash_dedup.near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text"))
    gone = near.where("not kept").select(F.col("doc_id").alias("__row"))
    return rows.join(gone, "__row", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    gone = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"), with_key=True).where("contaminated")
    gone = gone.select(F.col("row_key").alias("__gone")).distinct()
    return docs.join(gone, decontamination.row_key(docs) == F.col("__gone"), "left_anti")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document, and the output shards that hold them."""
    return mixing.mixed(docs)


STAGES = [("quality classifier", quality_stage), ("line dedup", line_stage), ("MinHash near-dedup", near_stage),
          ("benchmark decontamination", decontamination_stage), ("mixing to target weights", mixing_stage)]

#: Learned scores and permutations have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{k}")
    return docs
