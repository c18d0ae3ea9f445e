"""Evidence graphs from trace telemetry, as Spark batch and streaming jobs."""
