"""inkgauge: a Spark-native engine that measures writing style and prepares text."""
