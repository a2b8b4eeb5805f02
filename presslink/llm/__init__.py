"""Training-data operators: archives, language, duplicates, mixing, packing, quality."""
