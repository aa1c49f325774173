"""Training-data operators: packing, fingerprints, joins, extraction, archives, mixing, models."""
