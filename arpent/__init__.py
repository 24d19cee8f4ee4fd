"""Spark-native market and energy analytics."""
