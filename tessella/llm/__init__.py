"""Training-data operators: chat formatting, search, decontamination, deduplication, scans, tokenisation.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports it.
"""
