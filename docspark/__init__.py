"""docspark: document-archive analytics as Spark DataFrame operators."""
