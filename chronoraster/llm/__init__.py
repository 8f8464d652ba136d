"""Training-data operators: splits, target sampling, packing, contamination, repetition."""
