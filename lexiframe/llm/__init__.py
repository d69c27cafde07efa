"""Training-data pipeline operators: packing, near-duplicates, URL filters, sharding,
LM scoring, language ID, toxicity, quality, nearest neighbours, piece sampling."""
