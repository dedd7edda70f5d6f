"""Training-data operators: tokenising, media, packing, privacy, archives, dedup, quality.

Nothing outside this subpackage imports it; it can be removed as a whole.
"""
