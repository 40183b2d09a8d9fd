"""threadloom: a PySpark-native engine for archives of agent conversations and curated notes."""
