"""Training-data operators: media columns, near-duplicates, mixing, quality,
packing, extraction, licences, substrings, toxicity and URL decisions."""
