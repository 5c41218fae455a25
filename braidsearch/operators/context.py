"""From ranked documents to context blocks, prompts, citations and result records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidsearch.functions.text import score_text, snippet, trim_whitespace

# Texts that a finished prompt or citation must contain word for word.
CONTEXT_TITLE, CONTEXT_CATEGORY = "Untitled Document", "General"
CITATION_DEFAULT = "Unknown"
PROMPT = """You are an AI Assistant designed to answer questions based on the provided context.
Answer the question using only the context provided. If you don't know the answer or if the context doesn't contain the answer, say "I don't know based on the provided context." Keep the response informative, professional, and clear.

Context:
{context}

Question: {question}

Answer:"""
SHORT_PROMPT = """Answer the user's question using the context below. If you don't know, state that you don't know.
        
        Context:
        {context}
        
        Question: {question}
        
        Answer:"""


def clean_questions(df: DataFrame, column: str = "question") -> DataFrame:
    """Trim white space and drop blank questions."""
    return df.withColumn(column, trim_whitespace(F.col(column))).filter(F.length(column) > 0)


def metadata_or(key: str, default: str, metadata: str = "metadata") -> Column:
    return F.coalesce(F.try_element_at(F.col(metadata), F.lit(key)), F.lit(default))


def context_entry() -> Column:
    """One numbered source; built by concatenation because texts may hold any pattern sign."""
    return F.concat(
        F.lit("["),
        F.col("rank").cast("string"),
        F.lit("] Source: "),
        metadata_or("title", CONTEXT_TITLE),
        F.lit(" (Category: "),
        metadata_or("category", CONTEXT_CATEGORY),
        F.lit(")\nContent: "),
        F.coalesce("text", F.lit("")),
    )


def gather(documents: DataFrame, entry: Column, score: str | None = None) -> DataFrame:
    """Per question its context, source count and sources in rank order; a group is a top-k list."""
    fields = [
        "rank",
        "doc_id",
        F.try_element_at("metadata", F.lit("title")).alias("title"),
        F.try_element_at("metadata", F.lit("category")).alias("category"),
        (F.col(score) if score else F.lit(None).cast("double")).alias("score"),
    ]
    ordered = F.array_sort(
        F.collect_list(F.struct("rank", entry.alias("entry"), F.struct(*fields).alias("source")))
    )
    return (
        documents.groupBy("query_id")
        .agg(ordered.alias("_ordered"))
        .select(
            "query_id",
            F.array_join(F.col("_ordered.entry"), "\n\n").alias("context"),
            F.size("_ordered").cast("bigint").alias("n_sources"),
            F.col("_ordered.source").alias("source_documents"),
        )
    )


def context_block(documents: DataFrame, score: str | None = None) -> DataFrame:
    """Ranked ``(query_id, rank, doc_id, text, metadata)`` to one context per question."""
    return gather(documents, context_entry(), score)


def stuffed_context(documents: DataFrame, score: str | None = None) -> DataFrame:
    """The texts alone, joined by blank lines."""
    return gather(documents, F.coalesce("text", F.lit("")), score)


def render(template: str, context: Column, question: Column) -> Column:
    """Fill a template that names ``{context}`` once, then ``{question}`` once.

    The pieces are concatenated, never replaced one after the other: a document
    that holds ``{question}`` must come through unchanged.
    """
    head, rest = template.split("{context}")
    middle, tail = rest.split("{question}")
    return F.concat(F.lit(head), context, F.lit(middle), question, F.lit(tail))


def result_records(
    questions: DataFrame, contexts: DataFrame, template: str = PROMPT
) -> DataFrame:
    """``(query_id, query, prompt, n_sources, source_documents)`` of every question.

    A question without sources keeps its row, with an empty context.
    """
    filled = questions.join(contexts, "query_id", "left")
    context = F.coalesce("context", F.lit(""))
    return filled.select(
        "query_id",
        F.col("question").alias("query"),
        render(template, context, F.col("question")).alias("prompt"),
        F.coalesce("n_sources", F.lit(0)).cast("bigint").alias("n_sources"),
        "source_documents",
    )


def citations(documents: DataFrame, score: str = "relevance_score") -> DataFrame:
    """Numbered source list: title, category, formatted score, text preview."""
    value = F.coalesce(F.col(score), F.lit(0.0)) if score in documents.columns else F.lit(0.0)
    return documents.select(
        "query_id",
        "rank",
        metadata_or("title", CITATION_DEFAULT).alias("title"),
        metadata_or("category", CITATION_DEFAULT).alias("category"),
        score_text(value).alias("score_text"),
        snippet(F.coalesce("text", F.lit(""))).alias("snippet"),
    )
