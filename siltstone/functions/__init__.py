"""Core functions."""
