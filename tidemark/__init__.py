"""tidemark: event-time market bars and training-data preparation on Spark."""
