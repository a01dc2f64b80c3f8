"""evidentia: a PySpark-native analytics engine for evidence-centred document archives."""
