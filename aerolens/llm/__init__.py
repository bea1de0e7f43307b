"""Training-data operators: mixing, deduplication, secret scans, scoring, search, packing, language identification."""
