"""Column functions: cleaning, tokens, keys and per-row features."""
