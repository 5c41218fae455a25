"""Whole jobs: ingest a corpus, answer a table of questions."""
