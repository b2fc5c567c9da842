"""Training-data operators: deduplication, token counts, toxicity, mixing and vector search."""
