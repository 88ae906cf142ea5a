"""Training-data operators: tokenising, packing, deduplication, filtering, extraction and search."""
