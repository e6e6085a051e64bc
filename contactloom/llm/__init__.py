"""Training-data operators: quality, licences, language, HTML, duplicates, sharding, tokens, search, packing.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
