"""folio: a PySpark engine for page corpora: cleaning, chunking, retrieval and ranking."""
