"""Training-data operators: deduplication, packing, tokenizers, extraction and scans."""
