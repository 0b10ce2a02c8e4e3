"""Training-data preparation: search, media, deduplication, sharding, tokenising, mixing, archives.

Nothing else in the package imports this subpackage.
"""
