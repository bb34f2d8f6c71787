"""Training-data operators: near-dedup, archives, secret scans, scoring, packing, quality, decontamination."""
