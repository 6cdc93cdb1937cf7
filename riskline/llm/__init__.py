"""Operators for preparing large text corpora: scoring, filtering, deduplicating, tokenising, sharding."""
