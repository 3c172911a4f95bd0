"""Operators for preparing training text: duplicates, filters, extraction, mixing and token output."""
