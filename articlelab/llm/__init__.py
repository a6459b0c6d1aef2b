"""Training-data pipeline operators: deduplication, quality, decontamination,
mixing, sharding, secret scans and binary token output."""
