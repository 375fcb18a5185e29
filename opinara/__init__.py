"""PySpark-native analytics for public-opinion data: posts, comments, topics, graphs."""
