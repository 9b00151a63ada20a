"""Training-data operators: packing, deduplication, scoring and archive formats.

Nothing outside this subpackage imports it.
"""
