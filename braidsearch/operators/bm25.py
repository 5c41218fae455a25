"""BM25: corpus statistics, the two weightings, and scores of all matching pairs.

Two weightings live side by side and never share an idf:

* *vector* weighting: saturated document weights (k1 1.2), question weights
  ``ln((N+1)/(df+0.5))`` scaled to sum to 1 per question;
* *Okapi* scoring (k1 1.5): ``ln((N-df+0.5)/(df+0.5))`` with a floor for terms in
  more than half of the documents, repeated question terms counting again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from braidsearch.functions.text import Analysis, Analyzer, simple_tokens, term_id
from braidsearch.operators.index import count_terms, postings, unfold_terms
from braidsearch.operators.ranking import (
    broadcast_within,
    fits_broadcast,
    text_bytes,
)
from braidsearch.schemas import MODEL_STATS
from braidsearch.session import fresh_path

# Parameters of the two weightings and the floor of negative Okapi idf.
VECTOR_K1, OKAPI_K1, B = 1.2, 1.5, 0.75
OKAPI_FLOOR = 0.25


@dataclass(frozen=True)
class Bm25Model:
    """A fitted corpus: a few scalars and the vocabulary table ``(term, term_id, df)``.

    ``k1`` and ``b`` are those of the vector weighting, ``analysis`` says how texts were cut.
    """

    n_docs: int
    avgdl: float
    n_terms: int
    sum_df: int
    mean_idf: float
    vocabulary: DataFrame
    k1: float = VECTOR_K1
    b: float = B
    analysis: Analysis = Analysis()


def copies_of(index: DataFrame) -> Column:
    """Documents a row stands for: its ``copies`` where equal texts were merged, else one."""
    return F.col("copies") if "copies" in index.columns else F.lit(1).cast("bigint")


def doc_freq(index: DataFrame) -> DataFrame:
    """``(term, df)``. Terms are distinct within a row, and hot terms combine map-side."""
    listed = unfold_terms(index, copies_of(index).alias("copies"))
    return listed.groupBy("term").agg(F.sum("copies").alias("df"))


def term_totals(index: DataFrame) -> DataFrame:
    """``(term, df, count)``: documents that hold a term and how often it stands in them.

    Totals of several tables add up. Only ``(term, counts)`` is shuffled.
    """
    listed = unfold_terms(index, copies_of(index).alias("copies"))
    return listed.groupBy("term").agg(
        F.sum("copies").alias("df"), F.sum(F.col("tf") * F.col("copies")).alias("count")
    )


def number_of_docs(index: DataFrame) -> Column:
    """Aggregate: documents that the rows stand for."""
    return F.coalesce(F.sum(copies_of(index)), F.lit(0))


def corpus_stats(index: DataFrame) -> DataFrame:
    """One row ``(n_docs, total_dl, avgdl)``; empty documents count."""
    copies = copies_of(index)
    return index.agg(
        F.coalesce(F.sum(copies), F.lit(0)).alias("n_docs"),
        F.coalesce(F.sum(F.col("dl") * copies), F.lit(0)).alias("total_dl"),
    ).withColumn("avgdl", F.try_divide(F.col("total_dl").cast("double"), F.col("n_docs")))


def raw_okapi_idf(n_docs: int) -> Column:
    df = F.col("df")
    return F.log((F.lit(float(n_docs)) - df + 0.5) / (df + 0.5))


def okapi_idf(n_docs: int, mean_idf: float) -> Column:
    """Okapi idf of column ``df``; a negative value becomes a share of the vocabulary's mean."""
    idf = raw_okapi_idf(n_docs)
    return F.when(idf < 0, F.lit(OKAPI_FLOOR * mean_idf)).otherwise(idf)


def fit(
    index: DataFrame,
    path: str | None = None,
    analysis: Analysis = Analysis(),
    k1: float = VECTOR_K1,
    b: float = B,
) -> Bm25Model:
    """Fit the model and save it under ``path`` (default: the shared work folder).

    Texts are analysed once; counting documents needs no text.
    """
    n_docs = index.agg(number_of_docs(index)).first()[0]
    return fit_totals(term_totals(index), n_docs, path, analysis, k1, b)


def fit_totals(
    totals: DataFrame,
    n_docs: int,
    path: str | None = None,
    analysis: Analysis = Analysis(),
    k1: float = VECTOR_K1,
    b: float = B,
) -> Bm25Model:
    """Fit the model from `term_totals` of ``n_docs`` documents and save it under ``path``.

    ``path/df`` holds the vocabulary, ``path/stats`` one row of scalars. The lengths of all documents add up
    to the terms' counts, which are kept with the vocabulary.
    """
    spark = totals.sparkSession
    path = path or fresh_path(spark, "model")
    if n_docs == 0:
        raise ValueError("cannot fit BM25 on an empty corpus")
    vocabulary = totals.select("term", term_id(F.col("term")).alias("term_id"), "df", "count")
    vocabulary.write.mode("overwrite").parquet(f"{path}/df")
    written = spark.read.parquet(f"{path}/df")
    total = written.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    row = (int(n_docs), total / n_docs, k1, b, *analysis.flags())
    spark.createDataFrame([row], MODEL_STATS).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    return model_of(int(n_docs), total / n_docs, written.drop("count"), k1, b, analysis)


def model_of(
    n_docs: int,
    avgdl: float,
    vocabulary: DataFrame,
    k1: float = VECTOR_K1,
    b: float = B,
    analysis: Analysis = Analysis(),
) -> Bm25Model:
    totals = vocabulary.agg(
        F.count("*").alias("n_terms"),
        F.coalesce(F.sum("df"), F.lit(0)).alias("sum_df"),
        F.coalesce(F.avg(raw_okapi_idf(n_docs)), F.lit(0.0)).alias("mean_idf"),
    ).first()
    scalars = (int(totals.n_terms), int(totals.sum_df), float(totals.mean_idf))
    return Bm25Model(n_docs, avgdl, *scalars, vocabulary, k1, b, analysis)


def length_norm(avgdl: float, k1: float, b: float) -> Column:
    # a corpus of empty documents has avgdl 0 and no postings to weigh
    return k1 * (1 - b + b * F.col("dl") / (avgdl or 1.0))


def vector_weight(model: Bm25Model, tf: Column) -> Column:
    """Saturated document weight in [0, 1), for a row with column ``dl``."""
    return tf / (length_norm(model.avgdl, model.k1, model.b) + tf)


def okapi_weight(model: Bm25Model, tf: Column, k1: float = OKAPI_K1, b: float = B) -> Column:
    """The document factor of the Okapi score, for a row with column ``dl``."""
    return tf * (k1 + 1) / (length_norm(model.avgdl, k1, b) + tf)


def encode_documents(index: DataFrame, model: Bm25Model) -> DataFrame:
    """Sparse document vectors in long form: ``(doc_id, term, weight)``."""
    return postings(index).select(
        "doc_id", "term", vector_weight(model, F.col("tf")).alias("weight")
    )


def sparse_vectors(index: DataFrame, model: Bm25Model) -> DataFrame:
    """Sparse document vectors packed per row: ``struct<indices, values>`` sorted by term id."""
    packed = F.array_sort(
        F.transform(
            "terms",
            lambda t: F.struct(
                term_id(t["term"]).alias("id"), vector_weight(model, t["tf"]).alias("weight")
            ),
        )
    )
    return index.withColumn("_packed", packed).select(
        "doc_id",
        F.struct(
            F.col("_packed.id").alias("indices"), F.col("_packed.weight").alias("values")
        ).alias("sparse"),
    )


def question_terms(questions: DataFrame, analyzer: Analyzer = simple_tokens) -> DataFrame:
    """``(query_id, question)`` to ``(query_id, term, qtf)``."""
    counted = count_terms(questions, analyzer, text="question")
    return unfold_terms(counted, "query_id").withColumnRenamed("tf", "qtf")


def terms_size(q_terms: DataFrame) -> int:
    """Bytes of a table of question terms, measured before it is broadcast."""
    return q_terms.agg(text_bytes(F.col("term"))).first()[0]


def with_df(q_terms: DataFrame, model: Bm25Model, size: int) -> DataFrame:
    """Attach ``df`` to question terms of ``size`` bytes, 1 for a term no document has.

    The vocabulary grows with the corpus, the question terms do not: the terms are
    what is broadcast, and the vocabulary is only streamed past them.
    """
    wanted = broadcast_within(q_terms.select("term").distinct(), size)
    known = model.vocabulary.join(wanted, "term", "left_semi").select("term", "df")
    return q_terms.join(broadcast_within(known, size), "term", "left").withColumn(
        "df", F.coalesce("df", F.lit(1))
    )


def encode_queries(
    q_terms: DataFrame, model: Bm25Model, size: int | None = None
) -> DataFrame:
    """Sparse question vectors ``(query_id, term, weight)``; the weights of a question sum to 1.

    ``size`` is that of ``q_terms`` in bytes, where it is already known.
    """
    idf = F.log((F.lit(float(model.n_docs)) + 1) / (F.col("df") + 0.5))
    size = terms_size(q_terms) if size is None else size
    weighted = with_df(q_terms, model, size).withColumn("idf", idf)
    per_question = Window.partitionBy("query_id")
    return weighted.select(
        "query_id", "term", (F.col("idf") / F.sum("idf").over(per_question)).alias("weight")
    )


def okapi_queries(
    q_terms: DataFrame, model: Bm25Model, size: int | None = None
) -> DataFrame:
    """Okapi question weights ``(query_id, term, weight)``; only terms the corpus has."""
    size = terms_size(q_terms) if size is None else size
    wanted = broadcast_within(q_terms, size)
    idf = okapi_idf(model.n_docs, model.mean_idf)
    return model.vocabulary.join(wanted, "term").select(
        "query_id", "term", (F.col("qtf") * idf).alias("weight")
    )


def weigh_terms(index: DataFrame, weight: Column) -> DataFrame:
    """``(doc_id, term, weight)`` with ``weight`` an expression over ``tf`` and ``dl``."""
    return postings(index).select("doc_id", "term", weight.alias("weight"))


def sparse_scores(doc_weights: DataFrame, query_weights: DataFrame, size: int) -> DataFrame:
    """``(query_id, doc_id, score)`` of every pair sharing a term.

    ``size`` bounds the bytes of ``query_weights``. Within the broadcast limit the postings stay
    where they are: with an index bucketed by ``doc_id`` the sum needs no shuffle
    either. Beyond it both sides are shuffled by term; AQE splits the postings of a hot term over as
    many tasks as their bytes need.
    """
    q = query_weights.withColumnRenamed("weight", "query_weight")
    asked = F.broadcast(q) if fits_broadcast(size) else q.hint("shuffle_merge")
    matched = doc_weights.join(asked, "term")
    score = F.sum(F.col("weight") * F.col("query_weight"))
    return matched.groupBy("query_id", "doc_id").agg(score.alias("score"))


def okapi_scores(
    q_terms: DataFrame, index: DataFrame, model: Bm25Model, size: int | None = None
) -> DataFrame:
    """Okapi BM25 score of every matching (question, document) pair."""
    size = terms_size(q_terms) if size is None else size
    doc_weights = weigh_terms(index, okapi_weight(model, F.col("tf")))
    return sparse_scores(doc_weights, okapi_queries(q_terms, model, size), size)
