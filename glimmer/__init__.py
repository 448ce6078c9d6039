"""glimmer: Spark-native localization and trajectory analytics."""
