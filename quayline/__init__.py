"""quayline: a Spark-native engine for building, auditing and splitting labelled corpora."""

__version__ = "0.1.0"
