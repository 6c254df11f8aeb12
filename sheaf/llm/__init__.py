"""Training-data operators: fingerprints, licences, near duplicates, mixing, packing, quality, tokenising, URLs, toxicity."""
