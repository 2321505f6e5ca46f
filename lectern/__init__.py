"""lectern: a PySpark-native document retrieval and provenance engine."""
