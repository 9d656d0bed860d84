"""Operators for preparing training corpora.

Nothing outside this subpackage (and ``corpus_pipeline.py``, which belongs to it) imports it.
Each module holds one operator; :mod:`patchloom.llm.queries` holds the registered queries.
"""
