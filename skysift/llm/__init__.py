"""Operators of a training-data pipeline: mixing, packing, materialising, de-duplication, rules, search, extraction."""
