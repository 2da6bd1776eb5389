"""corpusforge.sources."""
