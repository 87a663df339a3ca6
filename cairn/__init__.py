"""cairn: a PySpark-native engine for annotated matrices, evidence tables and score ledgers."""
