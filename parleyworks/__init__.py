"""Support-conversation analytics and training-data preparation as Spark jobs."""
