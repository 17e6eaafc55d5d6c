"""tessera: a Spark-native analytics engine for conversation transcripts and other text."""
