"""Preparation of training data at scale: similarity, grouping, deduplication, packing, leakage, privacy."""
