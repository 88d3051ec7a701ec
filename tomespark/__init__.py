"""tomespark: Spark-native processing of reading collections and text corpora."""
