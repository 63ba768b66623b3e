"""Training-data operators: near-duplicates, personal data, mixing, quality, tokens, toxicity, secrets."""
