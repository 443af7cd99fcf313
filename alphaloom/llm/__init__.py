"""Training-data operators: quality, language, packing, deduplication and the like."""
