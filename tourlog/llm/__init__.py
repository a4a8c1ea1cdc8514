"""Operators for training data: dedup, tokens, scores, rules, mixing, extraction, shards, licences."""
