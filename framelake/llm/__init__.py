"""Training-data operators on Spark: quality, dedup, mixing, packing, fingerprints.

Nothing outside this subpackage imports it; its queries live in ``llm.queries``.
"""
