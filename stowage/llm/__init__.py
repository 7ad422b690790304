"""Training-data operators: language, quality, toxicity, duplicates, packing."""
