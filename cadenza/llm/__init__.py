"""Training-data operators: tokenising, deduplication, decontamination, privacy, sharding, filters, search."""
