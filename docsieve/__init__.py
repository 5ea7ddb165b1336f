"""docsieve: document scoring, matching and corpus processing on Spark."""
