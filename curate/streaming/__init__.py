"""Structured Streaming: annotation ingest, progress, replay windows and the best-so-far monitor."""
