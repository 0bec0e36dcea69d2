"""Training-data operators: quality, sharding, packing, near-dedup, toxicity,
decontamination, licences, secrets, token files and media columns.

Nothing else in the library imports this subpackage.
"""
