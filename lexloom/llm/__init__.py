"""Training-data operators: scoring, deduplication, filtering, sharding, packing and token output."""
