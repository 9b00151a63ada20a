"""tallywright: a PySpark-native engine for verification analytics."""
