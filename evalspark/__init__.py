"""PySpark-native evaluation analytics: every operator maps DataFrames to DataFrames."""
