"""Training-data operators: dedup, toxicity, archives, packing, search, mixing, secrets, counts.

Nothing outside this subpackage imports it.  ``queries`` holds the registered queries.
"""
