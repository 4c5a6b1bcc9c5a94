"""A PySpark-native library of operators on conversations, documents, market series and telemetry."""
