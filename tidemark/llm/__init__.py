"""Training-data operators: text formatting, counting, deduplication, filtering and packing at corpus scale."""
