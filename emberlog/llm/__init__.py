"""Operators for preparing large text corpora for model training.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; documents are rows with ``doc_id`` and ``text`` and may carry any
other columns.
"""
