"""Training-data operators: tokenising, search, deduplication, fixity,
licences, decontamination, sharding, extraction and toxicity.

Nothing else in the library imports this subpackage.
"""
