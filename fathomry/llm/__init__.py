"""Training-data operators: scoring, packing, joins, formatting, filters, sharding.

Nothing outside this subpackage imports it; ``registry`` lists its queries.
"""
