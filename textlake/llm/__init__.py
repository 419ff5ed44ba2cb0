"""Training-data operators: dedup, tokenising, mixing, filtering, language ID, token files and vector search."""
