"""Training-data operators: dedup, decontamination, filtering, tokenising, sharding.

Nothing else in the library imports this subpackage.
"""
