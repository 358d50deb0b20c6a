"""basalt: a PySpark-native engine for code and text corpus analytics."""
