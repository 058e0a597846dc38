"""Training-data operators: token codes, quality, near-duplicates, search, extraction,
mixing, archives, sub-word pieces and pseudonyms, each a DataFrame to DataFrame function.

Nothing outside this subpackage and ``corpus_pipeline.py`` imports it."""
