"""The queries of the training-data operators and their SQL."""

from marlstone.llm import compression_quality, decontamination, fill_middle, fragment_join, katz, licence_scan, mixing, near_duplicates, quality_rules, token_ids, url_filter, whitening

MODULES = [url_filter, token_ids, quality_rules, mixing, decontamination, katz, near_duplicates, licence_scan, compression_quality, whitening, fragment_join, fill_middle]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
