"""Core plans."""
