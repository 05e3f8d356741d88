"""Training-data operators: decontamination, mixing, PII, search, dedup, quality, token counts and LM scores."""
