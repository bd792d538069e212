"""Training-data operators: packing, extraction, filtering, mixing, scoring, sharding and near-duplicates."""
