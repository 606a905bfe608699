"""Training-data operators: packing, mixing, quality, dedup, sharding, licences."""
