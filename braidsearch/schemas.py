"""Explicit schemas of the tables this package reads and writes."""

from pyspark.sql import types as T

METADATA = T.MapType(T.StringType(), T.StringType())

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType(), False),
    T.StructField("text", T.StringType()),
    T.StructField("metadata", METADATA),
])

QUESTIONS = T.StructType([
    T.StructField("query_id", T.LongType(), False),
    T.StructField("question", T.StringType()),
])

CORPUS_JSON = T.StructType([
    T.StructField("page_content", T.StringType()),
    T.StructField("metadata", METADATA),
])

BM25_JSON = T.StructType([
    T.StructField("avgdl", T.DoubleType()),
    T.StructField("n_docs", T.LongType()),
    T.StructField("doc_freq", T.StructType([
        T.StructField("indices", T.ArrayType(T.LongType())),
        T.StructField("values", T.ArrayType(T.DoubleType())),
    ])),
    T.StructField("b", T.DoubleType()),
    T.StructField("k1", T.DoubleType()),
    T.StructField("lower_case", T.BooleanType()),
    T.StructField("remove_punctuation", T.BooleanType()),
    T.StructField("remove_stopwords", T.BooleanType()),
    T.StructField("stem", T.BooleanType()),
    T.StructField("language", T.StringType()),
])

MODEL_STATS = T.StructType([
    T.StructField("n_docs", T.LongType()),
    T.StructField("avgdl", T.DoubleType()),
    T.StructField("k1", T.DoubleType()),
    T.StructField("b", T.DoubleType()),
    T.StructField("lower_case", T.BooleanType()),
    T.StructField("remove_punctuation", T.BooleanType()),
    T.StructField("remove_stopwords", T.BooleanType()),
    T.StructField("stem", T.BooleanType()),
    T.StructField("language", T.StringType()),
])

COLLECTION_META = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("dim", T.IntegerType(), False),
    T.StructField("metric", T.StringType(), False),
    T.StructField("buckets", T.IntegerType(), False),
])

COLLECTION_LOG = T.StructType([
    T.StructField("version", T.IntegerType()),
    T.StructField("base", T.IntegerType()),
    T.StructField("buckets", T.IntegerType()),
])

RANKED = T.StructType([
    T.StructField("query_id", T.LongType(), False),
    T.StructField("doc_id", T.LongType(), False),
    T.StructField("score", T.DoubleType(), False),
    T.StructField("rank", T.LongType(), False),
])
