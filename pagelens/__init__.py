"""pagelens: a Spark-native analytics engine for web-page snapshots."""
