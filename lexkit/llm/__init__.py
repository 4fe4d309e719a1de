"""Training-data operators: packing, toxicity, mixing, sharding, line dedup, LM
scoring, substring dedup, embedding near-dedup, nearest neighbours, n-gram join."""
