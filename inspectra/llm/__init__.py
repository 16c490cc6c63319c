"""Training-data operators: filters, dedup, mixing, packing, extraction, scoring."""
