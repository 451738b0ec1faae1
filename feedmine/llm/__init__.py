"""Operators of a training-data pipeline: token counts, sharding, fingerprints, BPE,
bit-packed token files, quality rules, secret scans, near duplicates, packing, WARC.

Nothing else in the library imports this subpackage. ``queries.py`` registers one query
per operator; ``corpus_pipeline.py`` at the repository top chains four of them.
"""
