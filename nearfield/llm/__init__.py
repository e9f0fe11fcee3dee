"""Training-data operators: scoring, sharding, extraction, dedup, mixing, rules, tokens, chat."""
