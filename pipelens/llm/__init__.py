"""Training-data operators: packing, filtering, deduplication, search and extraction."""
