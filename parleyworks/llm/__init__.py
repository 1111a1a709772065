"""Training-data operators: deduplication, filtering, mixing, counting and packing of documents."""
