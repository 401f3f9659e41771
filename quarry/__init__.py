"""Spark-native analytics engine: relational, statistical, graph and spatial operators over DataFrames."""
