"""Training-data operators: readers, mixing, cleaning, deduplication and token output.

Nothing outside this subpackage imports it.
"""
