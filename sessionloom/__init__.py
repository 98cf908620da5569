"""sessionloom: a PySpark-native engine for building, auditing and querying session corpora."""

__version__ = "0.1.0"
