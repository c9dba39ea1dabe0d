"""Training-data operators over documents, pages and embeddings.

Nothing outside this subpackage imports it; `corpus_pipeline.py` and the
guarded block of `__spark_entry__.py` are its only users.
"""
