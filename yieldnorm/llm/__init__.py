"""Training-data operators: quality, secrets, mixing, deduplication, token counts, toxicity,
packing and sharding. Nothing else in the library imports this subpackage."""
