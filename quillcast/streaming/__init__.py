"""The stateful steps as Structured Streaming jobs."""
