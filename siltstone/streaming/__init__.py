"""Core streaming."""
