"""Training-data operators: dedup, joins, packing, filters, extraction and
scoring over ``documents`` / ``pages`` / ``benchmark``.

Nothing else in the library imports this subpackage.
"""
