"""procgraph: a PySpark-native engine for document and process-graph analytics."""
