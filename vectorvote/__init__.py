"""A PySpark-native engine for nearest-neighbour voting, feature vectors and corpus preparation."""
