"""Spark-native analytics for software-vulnerability intelligence."""
