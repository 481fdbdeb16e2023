"""Operators of a training-data pipeline, their queries and their SQL.

Nothing outside this folder, `tests/llm` and `corpus_pipeline.py` imports it.
"""
