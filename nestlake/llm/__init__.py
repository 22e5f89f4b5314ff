"""Operators for training text: encoding repair, term counts, language, packing, mixing, subjects."""
