"""Training-data operators: tokenizing, filtering, de-duplication and search over large corpora.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
