"""PySpark-native data-privacy workbench."""
