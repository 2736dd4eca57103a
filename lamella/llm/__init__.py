"""Training-data operators: dedup, toxicity, search, mixing, sharding, packing, chat formatting."""
