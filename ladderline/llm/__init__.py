"""Training-data operators: fingerprints, packing, PII, quality, licences, mixing, dedup, secrets."""
