"""Training-data operators: mixing, deduplication, fingerprints, URL and
toxicity filters, packing and token counts.  Nothing else in the library
imports this subpackage."""
