"""segline: media-stream timelines and delivery logs as Spark DataFrame jobs."""
