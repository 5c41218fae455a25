"""DataFrame operators: indexing, sparse and dense retrieval, fusion, rerank, context."""
