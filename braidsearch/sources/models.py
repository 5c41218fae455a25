"""Loading a BM25 model saved by `bm25.fit`, and its exchange as JSON."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidsearch.functions.text import Analysis, murmur_term_id
from braidsearch.operators.bm25 import Bm25Model, model_of
from braidsearch.schemas import BM25_JSON, MODEL_STATS
from braidsearch.sources.tables import path_exists

FLAGS = [field.name for field in MODEL_STATS.fields[4:]]


def load_model(spark: SparkSession, path: str) -> Bm25Model:
    if not path_exists(spark, f"{path}/stats"):
        raise FileNotFoundError(f"no BM25 model at {path}; run the ingestion first")
    stats = spark.read.schema(MODEL_STATS).parquet(f"{path}/stats").first()
    analysis = Analysis(*(stats[flag] for flag in FLAGS))
    vocabulary = spark.read.parquet(f"{path}/df").select("term", "term_id", "df")
    return model_of(stats.n_docs, stats.avgdl, vocabulary, stats.k1, stats.b, analysis)


def export_json(model: Bm25Model, path: str) -> None:
    """Write the model as JSON keyed by Murmur3 term ids.

    ``path/stats`` is one object of scalars and flags, ``path/doc_freq`` a line for each term, written by as
    many tasks as the vocabulary has partitions.
    """
    spark = model.vocabulary.sparkSession
    row = (model.n_docs, model.avgdl, model.k1, model.b, *model.analysis.flags())
    stats = spark.createDataFrame([row], MODEL_STATS).coalesce(1)
    stats.write.mode("overwrite").json(f"{path}/stats")
    terms = model.vocabulary.select(murmur_term_id("term").alias("term_id"), "df")
    terms.write.mode("overwrite").json(f"{path}/doc_freq")


def import_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """An exported folder as ``stats`` (one row) and ``df`` (``term_id, df``)."""
    stats = spark.read.schema(MODEL_STATS).json(f"{path}/stats")
    return stats, spark.read.schema("term_id bigint, df bigint").json(f"{path}/doc_freq")


def import_json_object(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The same from a foreign file: one object that holds all terms in two arrays."""
    model = spark.read.schema(BM25_JSON).option("multiLine", True).json(path)
    pairs = F.arrays_zip(F.col("doc_freq.indices"), F.col("doc_freq.values"))
    df = model.select(F.explode(pairs).alias("pair")).select(
        F.col("pair.indices").alias("term_id"), F.col("pair.values").cast("bigint").alias("df")
    )
    return model.drop("doc_freq"), df


def imported_model(q_terms: DataFrame, stats: DataFrame, df: DataFrame) -> Bm25Model:
    """A model for weighing ``q_terms`` with imported statistics.

    They know terms only by id, so the terms of the questions get their ids here and stand in
    for the vocabulary; scalars, parameters and flags are those of the file.
    """
    totals = stats.first()
    asked = q_terms.select("term").distinct().withColumn("term_id", murmur_term_id("term"))
    analysis = Analysis(*(totals[flag] for flag in FLAGS))
    whole = model_of(totals.n_docs, totals.avgdl, df, totals.k1, totals.b, analysis)
    known = asked.join(df, "term_id").select("term", "term_id", "df")
    return replace(whole, vocabulary=known)
