"""weir: text, basket, vector, telemetry and capacity analytics as Spark jobs."""
