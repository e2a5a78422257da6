"""Training-data operators: packing, scanning, filtering, formatting and deduplication."""
