"""Training-data operators: text quality, tokens, near-duplicates, decontamination, privacy."""
