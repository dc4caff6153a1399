"""Training-data operators: filters, dedup, search, models, archives.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
