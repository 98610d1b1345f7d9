"""Scheduled scans as Structured Streaming jobs."""
