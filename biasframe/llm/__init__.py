"""Training-data operators (quality, secrets, language model, mixing, BPE, search, dedup, WARC, sharding)."""
