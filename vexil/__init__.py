"""PySpark-native engine for vector tables, clustering, text preparation and event streams."""
