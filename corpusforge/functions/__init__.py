"""corpusforge.functions."""
