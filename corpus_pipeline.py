"""Documents to training tokens: five stages, each an operator of the corpus subpackage.

Each stage reads all that the one before kept, from Parquet in the cluster's shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm import decontaminate, lines, pieces, quality, simhash
from lintlake.llm.shared import fresh_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base or whose posterior quality is below a half go."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go from every text; no document goes."""
    kept = lines.dedup_lines(docs)
    n_chars = [F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")] if "n_chars" in docs.columns else []
    return kept.select(*(c for c in docs.columns if c != "n_chars"), *n_chars).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each class stays."""
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a half or more of a benchmark text go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of each text, and whether they spell it."""
    coded = pieces.encode(docs.select("doc_id", "lang", "source", "text"), check_col="lossless")
    n_pieces = F.when(F.col("ids").isNull(), 0).otherwise(F.size("ids")).cast("long")
    return coded.select("doc_id", "lang", "source", "ids", n_pieces.alias("n_pieces"), "lossless")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]
#: Expectation-maximisation, fingerprints and merge agendas are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
