"""Training-data operators: deduplication, scans, scoring, packing and mixing over a documents table."""
