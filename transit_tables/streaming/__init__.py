"""Live operators as Structured Streaming queries."""
