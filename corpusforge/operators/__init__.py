"""corpusforge.operators."""
