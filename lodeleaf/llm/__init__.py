"""Training-data operators: near-duplicates, splitting, history deduplication, vector neighbours,
term counts, sentences, packing, mixing and redaction.  Nothing outside this folder imports it."""
