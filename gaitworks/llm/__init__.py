"""Training-data operators over episode records: search, dedup, scans, token files, mixing, packing."""
