"""Operators for preparing training text: scoring, mixing, deduplication, packing, privacy and archives."""
