"""Training-data operators: packing, toxicity, token stores, quality, language-model
scoring, near-duplicates, exact top-k search, media columns, mixing and HTML extraction.

Nothing outside this subpackage imports it.
"""
