"""Training-data operators: scans, classifiers, near-duplicate joins, mixing, packing and sharding.

Nothing outside this subpackage imports it; its queries are in :mod:`axonframe.llm.queries`.
"""
