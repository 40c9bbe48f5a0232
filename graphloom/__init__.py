"""A PySpark-native knowledge-graph and corpus analytics engine."""
