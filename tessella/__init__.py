"""tessella: a Spark-native analytics engine for revisioned, sentence-structured corpora."""
