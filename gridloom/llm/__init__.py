"""Training-data operators: text quality, search, dedup, formatting, archives and token counts."""
