"""docscore: a Spark-native engine for evaluating document-extraction runs."""
