"""Training-data operators: quality, deduplication, mixing, packing, search and extraction on Spark."""
