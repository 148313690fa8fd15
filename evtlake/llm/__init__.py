"""Training-data operators: dedup, filters, packing and WARC derivatives on Spark."""
