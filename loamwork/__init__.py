"""A Spark-native engine that turns stored pages and documents into validated records."""
