"""Training-data operators: decontamination, deduplication, extraction, scoring, packing, sharding."""
