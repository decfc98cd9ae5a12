"""Corpus operators for training-data pipelines: dedup, decontamination, scoring, packing.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it, so it can be removed whole.
Every operator takes and returns DataFrames, reads whole texts, and joins on ``doc_id`` plus a text
hash, so repeated rows get the same answer and never multiply.
"""
