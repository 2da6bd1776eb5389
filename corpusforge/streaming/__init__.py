"""corpusforge.streaming."""
