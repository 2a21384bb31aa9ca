"""Training-data operators: language id, quality, decontamination, secrets, toxicity,
similarity join, line dedup, personal data, sub-word encoding and sharding."""
