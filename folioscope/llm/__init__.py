"""Training-data operators: scans, tokenization, packing, fingerprints and near-duplicates.

Nothing outside this package (and ``corpus_pipeline.py`` at the repository top) imports it.
"""
