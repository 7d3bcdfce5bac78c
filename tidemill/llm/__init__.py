"""Operations of a training-data pipeline: ten operators on documents, pages and conversations.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
