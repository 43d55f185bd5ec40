"""Corpus-preparation operators for training data (packing, PII, quality, search, ...)."""
