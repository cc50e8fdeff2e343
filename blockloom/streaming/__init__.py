"""The same steps over streams: Structured Streaming with checkpointed state."""
