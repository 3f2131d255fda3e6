"""millrace: a PySpark-native relational engine (DataFrame and SQL first)."""
