"""Training-data operators: extraction, deduplication, filtering, packing, sharding, search.

Nothing outside this package imports it; ``registry`` lists its queries and their SQL.
"""
