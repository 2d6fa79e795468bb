"""Training-data operators: cleaning, deduplication, mixing and packing of document corpora."""
