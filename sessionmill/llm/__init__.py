"""Operators of a training-data pipeline over tables of documents.

Nothing outside this folder, ``corpus_pipeline.py`` and ``tests/llm`` depends on it.
"""
