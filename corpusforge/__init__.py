"""corpusforge: a PySpark-native engine for curating and measuring large text corpora."""
