"""Training-data operators: mixing, decontamination, language ID, PII, near-dedup, line dedup,
licences, toxicity, chat formatting and quality rules. Nothing else in the library imports this."""
