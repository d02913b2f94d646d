"""Structured Streaming versions: event windows and incremental panels."""
