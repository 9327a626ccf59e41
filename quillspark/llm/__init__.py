"""Training-data operators: classification, rules, sharding, decontamination, archives, dedup, tokens, PII."""
