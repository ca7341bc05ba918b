"""Operators for training-data pipelines: de-duplication, tokens, search, quality, extraction, decontamination."""
